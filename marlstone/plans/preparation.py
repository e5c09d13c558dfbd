"""Queries of the preparation operators that live in the core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators.instants import instants
from marlstone.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return instants(table(spark, sf_dir, "all_sms"), table(spark, sf_dir, "backup_files"))


def p2_by_field_and_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = p2_found(spark, sf_dir)
    return found.groupBy("field", F.date_format(F.timestamp_micros("utc_us"), "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


QUERIES = {"p2_found": p2_found, "p2_by_field_and_month": p2_by_field_and_month}
ORACLES: dict[str, str] = {}
