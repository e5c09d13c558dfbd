"""Duplicates hidden by formatting: one record for each, with its number of copies.

Rows become canonical bytes (case, white space, punctuation and marks gone; labelled parts in one order). Each input
partition first counts in tries of its own, so a record that fills a third of all rows leaves it as a few rows. Then
keys are partitioned by their first two bytes; a bucket over the limit is split by further bytes behind those that all its
keys share, as many as its size asks for, round after round until each fits a trie; the tries' terminal counters are the
result. No bucket is ever collected whole.
"""

from __future__ import annotations

import os.path
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.session import bounded_broadcast, require, written

#: Keys that a trie may hold; a bucket with more is split.
BUCKET_KEYS = 20_000
#: Bytes of the first split.
FIRST_BYTES = 2
#: Keys of an oversized bucket that are looked at to choose how many bytes its split takes; whether parts fit is counted.
PICKS = 256

_LABEL = r"[^\W\d_]+(?:/[^\W\d_]+)?\s*:(?!//)"
_DROP = r"[^\p{L}\p{M}\p{N}\p{Sc}]+"


def bare(text: Column) -> Column:
    """Letters, marks, digits and currency signs in capitals; ``ß`` and ``SS`` agree, as do all sigmas."""
    return F.upper(F.regexp_replace(text, _DROP, ""))


def canonical_text(text: Column) -> Column:
    """``bare`` text; where two or more ``label: value`` parts stand, behind a heading or not, they are sorted."""
    # With a line break before it, a text that begins with a label has an empty heading.
    parts = F.split(F.concat(F.lit("\n"), text), rf"(?U)[\s;,/|]+(?={_LABEL})")
    parts_bare = F.transform(parts, bare)
    labelled = F.concat(F.element_at(parts_bare, 1), F.array_join(F.array_sort(F.slice(parts_bare, 2, F.greatest(F.size(parts_bare) - 1, F.lit(0)))), ""))
    return F.when(text.rlike(rf"(?U)(?s)(?:^|[\s;,/|]){_LABEL}.*[\s;,/|]{_LABEL}"), labelled).otherwise(bare(text))


class CountingTrie:
    """Keys with the number of their rows and the least id at each terminal node."""

    def __init__(self):
        self.trie = ahocorasick.Automaton()

    def __len__(self) -> int:
        return len(self.trie)

    def add(self, key: str, n: int, first) -> None:
        at = self.trie.get(key, None)
        if at is None:
            self.trie.add_word(key, [n, first])
        else:
            at[0] += n
            if first < at[1]:
                at[1] = first

    def drain(self) -> Iterator[tuple[str, int, object]]:
        for key, (n, first) in self.trie.items():
            yield key, n, first
        self.trie = ahocorasick.Automaton()


def _batch(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    keys, ns, ids = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_pydict({"key": pa.array([k.encode("latin-1") for k in keys], pa.binary()), "n": pa.array(ns, pa.int64()), "first_id": pa.array(ids, id_type)})


def _precounted(limit: int):
    """Each partition's own counts; a full trie is passed on, so memory is bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, kind = CountingTrie(), pa.int64()
        for b in batches:
            kind = b.schema.field("id").type
            for key, i in zip(b.column("key").to_pylist(), b.column("id").to_pylist()):
                trie.add(key.decode("latin-1"), 1, i)
            if len(trie) >= limit:
                yield _batch(list(trie.drain()), kind)
        yield _batch(list(trie.drain()), kind)

    return run


def _bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets come sorted; each is counted in a trie of its own and gives its records with two or more rows."""
    trie, bucket, kind, out = CountingTrie(), None, pa.int64(), []
    for b in batches:
        kind = b.schema.field("first_id").type
        for at, key, n, first in zip(*(b.column(c).to_pylist() for c in ("bucket", "key", "n", "first_id"))):
            if at != bucket:
                out += [x for x in trie.drain() if x[1] > 1]
                bucket = at
                if len(out) >= 10_000:
                    yield _batch(out, kind)
                    out = []
            trie.add(key.decode("latin-1"), n, first)
    yield _batch(out + [x for x in trie.drain() if x[1] > 1], kind)


def _deeper(limit: int):
    """For each oversized bucket, the bytes of its next split: the fewest by which the largest part of its picks is small enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            widths = []
            for rows, *ends, picks in zip(*(b.column(c).to_pylist() for c in ("rows", "least", "most", "picks"))):
                keys = {*ends, *picks}
                enough = max(1.0, len(keys) * max(limit / rows, 4 / PICKS))
                shared, longest = len(os.path.commonprefix(ends)), max(map(len, keys))
                widths.append(bisect_left(range(longest), True, shared + 1, key=lambda w: max(Counter(k[:w] for k in keys).values()) <= enough))
            yield pa.RecordBatch.from_pydict({"bucket": b.column("bucket"), "width": pa.array(widths, pa.int32())})

    return run


def bucketed(keys: DataFrame, limit: int = BUCKET_KEYS) -> DataFrame:
    """``keys`` (``key`` binary, …) with ``bucket``, a hash of the prefix under which at most ``limit`` rows fall.

    A bucket whose rows all have one key fits however many they are; it needs one trie entry. All keys of a bucket lie
    between its least and its greatest, so the beginning of these two is shared by all and skipped: a split always parts
    the bucket. Different keys of it, picked by their hashes, tell how many bytes make its parts small enough. Each round
    is written, and only the rows of oversized buckets go on to the next.
    """
    rest, done, level = keys.withColumn("bucket", F.xxhash64(F.substring("key", 1, FIRST_BYTES))), None, 0
    while True:
        sizes = rest.groupBy("bucket").agg(F.count("*").alias("rows")).where(F.col("rows") > limit)
        sizes = bounded_broadcast(written(sizes, "radix-sizes"))
        # Keys are looked at in oversized buckets only; there can't be more of them than rows / limit.
        per = rest.join(sizes.select("bucket"), "bucket", "left_semi").withColumn("h", F.xxhash64("key")).groupBy("bucket", F.pmod("h", F.lit(PICKS)).alias("slot"))
        per = per.agg(F.count("*").alias("rows"), F.min("key").alias("least"), F.max("key").alias("most"), F.min_by("key", "h").alias("pick"))
        ends = per.groupBy("bucket").agg(F.sum("rows").alias("rows"), F.min("least").alias("least"), F.max("most").alias("most"), F.collect_list("pick").alias("picks"))
        over = written(ends.where("least <> most").mapInArrow(_deeper(limit), "bucket bigint, width int"), "radix-over")
        if over.isEmpty():
            return rest if done is None else done.unionByName(rest)
        over = bounded_broadcast(over)
        small = rest.join(over, "bucket", "left_anti")
        done = small if done is None else done.unionByName(small)
        split = rest.join(over, "bucket").withColumn("bucket", F.xxhash64(F.expr("substring(key, 1, width)"))).drop("width")
        rest, level = written(split.select(*rest.columns), f"radix-{level + 1}"), level + 1


def copies(messages: DataFrame, id_col: str = "id", text_col: str = "text", sender_col: str = "sender", limit: int = BUCKET_KEYS) -> DataFrame:
    """``(id, n_copies)`` of each record with two or more rows: the least id and the number of rows.

    Rows with a null or empty sender or text are no records. Exact repeats of a row count as rows; other columns are
    ignored. Texts without any letter, digit or currency sign are the same as each other, under one sender.
    """
    rows = require(messages, id_col, text_col, sender_col).where((F.col(text_col) != "") & (F.col(sender_col) != ""))
    key = F.encode(F.concat(canonical_text(F.col(text_col)), F.lit("\n"), bare(F.col(sender_col))), "utf-8")
    keyed = rows.select(F.col(id_col).alias("id"), key.alias("key"))
    kind = dict(keyed.dtypes)["id"]
    counted = written(keyed.mapInArrow(_precounted(limit), f"key binary, n bigint, first_id {kind}"), "radix-keys")
    found = bucketed(counted, limit).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_bucket_counts, f"key binary, n bigint, first_id {kind}")
    return found.select(F.col("first_id").alias("id"), F.col("n").alias("n_copies"))
