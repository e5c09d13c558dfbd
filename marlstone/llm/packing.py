"""Filling fixed-capacity windows with documents: sum-of-squares packing.

Each document goes where the sum of the squared counts of open windows per residual gap becomes smallest, which keeps
every gap size in stock and few of each. Documents are packed in shards; what lies in badly filled windows of all shards
is packed again in fewer shards, until one shard is left, so that open windows are few in the end, not few per shard.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.session import parallelism, require, written

#: Pieces that one shard packs.
SHARD_PIECES = 25_000
#: A window with at most this part of its capacity unused is closed after a round.
WASTE = 0.005
#: Context windows are a configuration table; more than these are refused rather than collected.
MAX_WINDOWS = 1000


def tokens(text: Column) -> Column:
    """Size under a byte-level tokenizer: one token for each UTF-8 byte, end mark not counted."""
    return F.octet_length(text).cast("long")


class SumOfSquares:
    """Open windows by residual gap."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.count = np.zeros(capacity + 1, dtype=np.int64)
        self.used = 0

    def place(self, size: int) -> int:
        """The number of the window that a piece of ``size`` goes into."""
        count, cap = self.count, self.capacity
        # A window of gap g becomes one of gap g - size: the sum of squares changes by 2 (N[g - size] - N[g]) + 2.
        gaps = np.flatnonzero(count[size:cap]) + size
        best, change = cap, 2 * count[cap - size] + 1 if size < cap else 0
        if len(gaps):
            after = np.where(gaps == size, 0, count[gaps - size])
            delta = 2 * (after - count[gaps]) + np.where(gaps == size, 1, 2)
            delta[gaps == size] = -2 * count[size] + 1
            k = int(np.argmin(delta))  # ties: the smallest gap
            if delta[k] <= change:
                best = int(gaps[k])
        if best == cap:
            bin_no, self.used = self.used, self.used + 1
        else:
            bin_no = self.open[best].pop()
            count[best] -= 1
        if (left := best - size) > 0:
            self.open[left].append(bin_no)
            count[left] += 1
        return bin_no


def _packed(batch: pd.DataFrame) -> pd.DataFrame:
    """One shard of one capacity: pieces from large to small, ties by document and piece."""
    batch = batch.sort_values(["size", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
    cap = int(batch["n_ctx"].iloc[0])
    packer = SumOfSquares(cap)
    batch["bin"] = [packer.place(s) for s in batch["size"].tolist()]
    filled = batch.groupby("bin")["size"].transform("sum")
    return batch.assign(gap=cap - filled)


def pieces(documents: DataFrame, windows: DataFrame) -> DataFrame:
    """``(window_id, n_ctx, doc_id, piece, n_pieces, size)``: a document above the capacity in full pieces and a rest."""
    caps = [tuple(r) for r in require(windows, "window_id", "n_ctx").where("n_ctx > 0").dropDuplicates(["window_id"]).limit(MAX_WINDOWS + 1).collect()]
    if len(caps) > MAX_WINDOWS:
        raise ValueError(f"more than {MAX_WINDOWS} windows")
    docs = require(documents, "doc_id", "text", "n_tokens").select("doc_id", F.coalesce("n_tokens", tokens(F.col("text"))).alias("n")).where("n > 0")
    each = F.array(*(F.struct(F.lit(w).cast("long").alias("window_id"), F.lit(c).cast("long").alias("n_ctx")) for w, c in caps)) if caps else F.array().cast("array<struct<window_id:bigint,n_ctx:bigint>>")
    sized = docs.select("doc_id", "n", F.explode(each).alias("w")).select("w.window_id", "w.n_ctx", "doc_id", "n", F.ceil(F.col("n") / F.col("w.n_ctx")).cast("long").alias("n_pieces"))
    return sized.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_pieces") - 1))).withColumn("size", F.least("n_ctx", F.col("n") - F.col("piece") * F.col("n_ctx"))).drop("n")


def packed(documents: DataFrame, windows: DataFrame, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """``(window_id, bin, doc_id, piece, n_pieces, size)``: which filled window each document, or piece, goes into.

    A null ``n_tokens`` is counted from the text; null and empty texts without a count have nothing to pack. Only a
    document above the capacity is split; exactly the capacity fits. Document ids must be unique; repeated windows count
    once; extra columns are ignored.
    """
    cols = ["window_id", "n_ctx", "doc_id", "piece", "n_pieces", "size"]
    todo, done, level = written(pieces(documents, windows), "pack-0"), None, 0
    # Full pieces are windows of their own; no choice is left for them.
    whole = todo.where("size = n_ctx").withColumn("bin", F.concat_ws("-", F.lit("full"), "doc_id", "piece"))
    todo, done = todo.where("size < n_ctx"), whole.select(*cols, "bin")
    shards, capacities = max(1, -(-todo.count() // shard_pieces)), max(1, todo.select("window_id").distinct().count())
    while True:
        salted = todo.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", F.lit(level)), F.lit(shards)).cast("long"))
        kind = dict(todo.dtypes)["doc_id"]
        # Groups are few and heavy: as many tasks as groups, however small they are in bytes.
        spread = salted.repartition(min(shards * capacities, parallelism(todo.sparkSession)), "window_id", "shard")
        out = spread.groupBy("window_id", "shard").applyInPandas(_packed, f"window_id bigint, n_ctx bigint, doc_id {kind}, piece bigint, n_pieces bigint, size bigint, shard bigint, bin bigint, gap bigint")
        out = written(out, f"pack-{level + 1}")
        named = out.withColumn("bin", F.concat_ws("-", F.lit(level), "shard", "bin"))
        if shards == 1:
            return done.unionByName(named.select(*cols, "bin")).select("window_id", "bin", "doc_id", "piece", "n_pieces", "size")
        closed = F.col("gap") <= F.col("n_ctx") * WASTE
        done = done.unionByName(named.where(closed).select(*cols, "bin"))
        todo, level = out.where(~closed).select(*cols), level + 1
        # At most half as many each time: as many rounds as the number of shards has bits.
        shards = min(shards // 2, max(1, -(-todo.count() // shard_pieces)))


def fill(assigned: DataFrame, windows: DataFrame) -> DataFrame:
    """For each capacity: filled windows, tokens in them, the part of the room that is used."""
    by = assigned.groupBy("window_id").agg(F.countDistinct("bin").alias("bins"), F.sum("size").alias("tokens"), F.countDistinct("doc_id").alias("docs"))
    return by.join(F.broadcast(windows.select("window_id", "n_ctx").dropDuplicates(["window_id"]).limit(MAX_WINDOWS)), "window_id").withColumn("used", F.round(F.col("tokens") / (F.col("bins") * F.col("n_ctx")), 6))
