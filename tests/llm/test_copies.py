import random
import unicodedata
from collections import defaultdict

from pyspark.sql import functions as F

from marlstone.llm.copies import bucketed, copies


def key(s):
    return "".join(c for c in s.upper() if unicodedata.category(c)[0] in "LMN" or unicodedata.category(c) == "Sc")


def noisy(rng, s):
    s = "".join(c.upper() if rng.random() < 0.3 else c for c in s)
    return s.replace(" ", rng.choice([" ", "  ", "\n", " - "])) + rng.choice(["", ".", "!", " "])


def test_against_brute_force_in_small_buckets(spark):
    """A limit of 5 keys makes buckets split many times; one record holds a third of all rows."""
    rng, rows = random.Random(1), []
    base = [f"Payment of Rs.{k} received for card {k % 7}, thank you" for k in range(60)] + [f"a{'b' * k}" for k in range(1, 40)]
    for i in range(900):
        t = base[0] if i % 3 == 0 else rng.choice(base)
        rows.append((i + 1, noisy(rng, t), noisy(rng, rng.choice(["VM-LUMBNK", "ab"]) if i % 3 else "VM-LUMBNK")))
    rows += [(2000, None, "x"), (2001, "t", None), (2002, "", "x"), (2003, "t", ""), (2004, "🙂", "q"), (2005, "!!", "q"), (1, rows[0][1], rows[0][2])]
    groups = defaultdict(list)
    for i, t, s in rows:
        if t and s:
            groups[key(t), key(s)].append(i)
    want = sorted((min(v), len(v)) for v in groups.values() if len(v) > 1)
    df = spark.createDataFrame(rows, "id bigint, text string, sender string").selectExpr("*", "'k' AS key", "1 AS n", "2 AS bucket")
    assert sorted(tuple(r) for r in copies(df, limit=5).collect()) == want
    assert sorted(tuple(r) for r in copies(df).collect()) == want
    assert copies(df.limit(0)).count() == 0


def test_labelled_parts_in_any_order(spark):
    rows = [
        (1, "Card alert\nAmt: 1,5 INR\nRef: A/9\nA/c: x1", "b"),
        (2, "CARD ALERT\nREF: A/9; A/C: X1; AMT: 1,5 INR", "B"),
        (3, "Card alert / A/c: x1 / Ref: A/9 / Amt: 1,5 INR", "b"),
        (4, "Card alert\nAmt: 1,5 INR\nRef: A/9\nA/c: x2", "b"),
        (5, "Grüße an alle", "z"),
        (6, "GRÜSSE AN ALLE", "Z"),
    ]
    got = sorted(tuple(r) for r in copies(spark.createDataFrame(rows, "id bigint, text string, sender string")).collect())
    assert got == [(1, 3), (5, 2)]


def test_two_parts_and_long_labels(spark):
    rows = [
        (1, "Notice\nVerwendungszweck: Miete\nAmt: 5", "b"), (2, "NOTICE; amt: 5; verwendungszweck: miete", "b"), (3, "Amt: 5, Ref: 7", "c"), (4, "ref: 7 / amt: 5", "C"),
        (5, "see https://a.example/x: y", "d"), (6, "See https a example x y", "d"),
    ]
    got = sorted(tuple(r) for r in copies(spark.createDataFrame(rows, "id bigint, text string, sender string")).collect())
    assert got == [(1, 2), (3, 2), (5, 2)]


def test_long_common_beginnings_take_few_rounds(spark, monkeypatch):
    """A family behind 200 common bytes, one hot key with many rows, and outliers that share only a part of the beginning."""
    from marlstone.llm import copies as module

    names, write = [], module.written
    monkeypatch.setattr(module, "written", lambda df, name: (names.append(name), write(df, name))[1])
    family = F.concat(F.lit("x" * 200), F.lpad(F.col("id").cast("string"), 7, "0"))
    outlier = F.concat(F.lit("x" * 3), F.col("id").cast("string"))
    text = F.when(F.col("id") % 3 == 0, F.lit("x" * 200 + "hot")).when(F.col("id") % 50 == 1, outlier).otherwise(family)
    keys = spark.range(30_000).select(F.encode(text, "utf-8").alias("key"))
    sizes = bucketed(keys, 500).groupBy("bucket").agg(F.count("*").alias("rows"), F.countDistinct("key").alias("keys")).collect()
    assert sum(r["rows"] for r in sizes) == 30_000
    assert all(r["rows"] <= 500 or r["keys"] == 1 for r in sizes)
    assert len([n for n in names if n.startswith("radix-") and n[6:].isdigit()]) <= 4


def test_every_bucket_fits(spark):
    keys = spark.range(500).select(F.encode(F.concat(F.lit("same long beginning of every key "), F.lpad(F.col("id").cast("string"), 6, "0")), "utf-8").alias("key"))
    sizes = bucketed(keys, 20).groupBy("bucket").count().collect()
    assert sum(r["count"] for r in sizes) == 500 and max(r["count"] for r in sizes) <= 20
