"""Building the gold set: exclusion, de-duplication against it, stratified draws, shuffling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions import patterns as P
from marlstone.functions.text import prefix
from marlstone.operators.extract import false_positive, other_category, transaction, transaction_category
from marlstone.operators.funnel import funnel
from marlstone.session import bounded_broadcast


def year_of(date: Column) -> Column:
    """The year of a date in ISO form; null for other forms."""
    return F.when(date.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(date, 1, 4).try_cast("int"))


def not_in_gold(rows: DataFrame, gold: DataFrame, text_col: str = "text", n: int = 80) -> DataFrame:
    """Rows whose first ``n`` characters begin no gold message; the rows aren't compared with each other."""
    known = gold.where("sms IS NOT NULL").select(prefix(F.col("sms"), n).alias("_p")).distinct()
    return rows.withColumn("_p", prefix(F.col(text_col), n)).join(bounded_broadcast(known), "_p", "left_anti").drop("_p")


def draw_key(seed: str, text: Column, id_: Column) -> Column:
    """A reproducible order: the same on every cluster and in SQL."""
    return F.md5(F.concat(F.lit(seed), F.coalesce(text, F.lit("")), id_.cast("string")))


def targets(spark: SparkSession, table: dict[int, dict[str, int]]) -> DataFrame:
    return spark.createDataFrame([(y, c, n) for y, cs in table.items() for c, n in cs.items()], "year int, cat string, n int")


def stratified(pool: DataFrame, wanted: DataFrame, seed: str = "42") -> DataFrame:
    """Up to ``n`` rows of each (year, cat), in the order of ``draw_key``; strata without rows give none.

    Rows of unwanted strata are dropped before the window. Within a stratum only the first ``n`` of each salted part go
    on to the final ranking, so a stratum of any size is ranked in parts.
    """
    keyed = pool.join(F.broadcast(wanted), ["year", "cat"]).withColumn("_k", draw_key(seed, F.col("text"), F.col("id")))
    salted = keyed.withColumn("_s", F.pmod(F.xxhash64("id"), F.lit(64)))
    part = F.row_number().over(Window.partitionBy("year", "cat", "_s").orderBy("_k"))
    first = salted.withColumn("_n", part).where("_n <= n").drop("_n")
    rank = F.row_number().over(Window.partitionBy("year", "cat").orderBy("_k"))
    return first.withColumn("_n", rank).where("_n <= n").drop("_n", "_s", "_k", "n")


def candidates(messages: DataFrame) -> DataFrame:
    """Funnel rows of a known year with ``is_txn`` and their category; statement and identity reminders are no transactions."""
    f = funnel(messages).withColumn("year", year_of(F.col("date"))).where("year IS NOT NULL AND text IS NOT NULL")
    txn = f.where(F.col("s5_not_collect") & ~false_positive(F.col("text"))).withColumn("cat", transaction_category(F.col("text"))).withColumn("is_txn", F.lit(True))
    non = f.where(~F.col("s5_not_collect")).withColumn("cat", other_category(F.col("text"))).withColumn("is_txn", F.lit(False))
    return txn.unionByName(non)


def expanded(messages: DataFrame, gold: DataFrame) -> DataFrame:
    """``(sms, sender, expected, is_txn)``: the new gold rows, shuffled; transactions that no extractor reads are left out."""
    spark = messages.sparkSession
    pool = not_in_gold(candidates(messages), gold)
    txn = stratified(pool.where("is_txn"), targets(spark, P.TRANSACTION_TARGETS)).withColumn("expected", F.to_json(transaction(F.col("text")), {"ignoreNullFields": "false"})).where("expected IS NOT NULL")
    non = stratified(pool.where("NOT is_txn"), targets(spark, P.OTHER_TARGETS)).withColumn("expected", F.lit("null"))
    both = txn.select("id", "text", "sender", "expected", "is_txn").unionByName(non.select("id", "text", "sender", "expected", "is_txn"))
    return shuffled(both, "7").select(F.col("text").alias("sms"), F.coalesce("sender", F.lit("nan")).alias("sender"), "expected", "is_txn")


def shuffled(rows: DataFrame, seed: str) -> DataFrame:
    return rows.orderBy(draw_key(seed, F.col("text"), F.col("id")))
