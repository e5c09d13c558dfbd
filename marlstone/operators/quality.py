"""Checks of the identifiers, senders and volumes of a message table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.funnel import not_own, sender_category
from marlstone.session import parallelism, written


def id_profile(df: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows, least, greatest and distinct numeric ids, and whether they are exactly 1..N or without a gap."""
    i = df.select(F.col(id_col).try_cast("long").alias("i"))
    p = i.agg(F.count("*").alias("n_rows"), F.min("i").alias("min_id"), F.max("i").alias("max_id"), F.countDistinct("i").alias("distinct_ids"))
    exact = (F.col("min_id") == 1) & (F.col("max_id") == F.col("n_rows")) & (F.col("distinct_ids") == F.col("n_rows"))
    return p.select("*", F.coalesce(exact, F.lit(False)).alias("exact_sequence"), F.coalesce(F.col("max_id") - F.col("min_id") + 1 == F.col("distinct_ids"), F.lit(False)).alias("contiguous"))


def _gaps_within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted ids: each two neighbours with a gap between them, and the partition's first and last id."""
    part, first, last = TaskContext.get().partitionId(), None, None

    def out(edge: bool, before: list, after: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"part": pa.array([part] * len(before), pa.int32()), "edge": pa.array([edge] * len(before), pa.bool_()), "i": pa.array(before, pa.int64()), "next": pa.array(after, pa.int64())})

    for b in batches:
        ids = b.column(0).to_numpy()
        if len(ids):
            first = ids[0] if first is None else first
            known = ids if last is None else np.concatenate([[last], ids])
            at = np.flatnonzero(known[1:] != known[:-1] + 1)
            yield out(False, known[at], known[at + 1])
            last = ids[-1]
    if last is not None:
        yield out(True, [first], [last])


def id_gaps(df: DataFrame, id_col: str = "id") -> DataFrame:
    """``(gap_start, gap_end, missing)`` between neighbouring ids.

    Ids are sorted in ranges of about equal size, however far apart they are; only the first and last id of each range,
    one row for each task, are put side by side to join the ranges up, and no list of expected ids is made. A gap too wide
    for a whole number of 64 bits has a null number.
    """
    i = df.select(F.col(id_col).try_cast("long").alias("i")).where("i IS NOT NULL").distinct()
    ranges = i.repartitionByRange(parallelism(df.sparkSession), "i").sortWithinPartitions("i")
    found = written(ranges.mapInArrow(_gaps_within, "part int, edge boolean, i bigint, next bigint"), "gaps")
    ends = found.where("edge").select(F.col("next").alias("i"), F.lead("i").over(Window.orderBy("part")).alias("next")).where("next > i + 1")
    both = found.where("NOT edge").select("i", "next").unionByName(ends)
    return both.select((F.col("i") + 1).alias("gap_start"), (F.col("next") - 1).alias("gap_end"), F.try_subtract(F.col("next") - 1, F.col("i")).alias("missing"))


def missing_ids(df: DataFrame, id_col: str = "id") -> DataFrame:
    """Every missing id between the least and the greatest."""
    return id_gaps(df, id_col).select(F.explode(F.sequence("gap_start", "gap_end")).alias("id"))


def missing_summary(df: DataFrame, k: int = 20, id_col: str = "id") -> DataFrame:
    """How many ids are missing, and the first ``k`` of them."""
    gaps = id_gaps(df, id_col)
    first = gaps.orderBy("gap_start").limit(k).select(F.explode(F.sequence("gap_start", F.least("gap_end", F.col("gap_start") + k - 1))).alias("id")).orderBy("id").limit(k)
    return gaps.agg(F.coalesce(F.sum("missing"), F.lit(0)).alias("n_missing")).crossJoin(F.broadcast(first.agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("first_missing"))))


def duplicate_ids(df: DataFrame, k: int = 20, id_col: str = "id") -> DataFrame:
    return df.groupBy(F.col(id_col).alias("id")).agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "id").limit(k)


def sender_totals(df: DataFrame) -> DataFrame:
    return df.where(not_own(F.col("sender"))).agg(F.count("*").alias("n_rows"), F.countDistinct("sender").alias("senders"))


def category_histogram(df: DataFrame) -> DataFrame:
    return df.where(not_own(F.col("sender"))).groupBy(sender_category(F.col("sender")).alias("sender_category")).agg(F.count("*").alias("n"))


def other_senders(df: DataFrame, k: int = 20) -> DataFrame:
    return df.where(not_own(F.col("sender")) & (sender_category(F.col("sender")) == "Others")).select("sender").distinct().orderBy("sender").limit(k)


def top_senders(df: DataFrame, k: int = 50) -> DataFrame:
    return df.where(not_own(F.col("sender")) & F.col("sender").isNotNull()).groupBy("sender").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "sender").limit(k)
