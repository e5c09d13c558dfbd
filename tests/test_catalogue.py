"""Runs, quality checks and the gold set."""

import random

from pyspark.sql import functions as F

from marlstone.operators import goldset as G
from marlstone.operators import quality as Q
from marlstone.operators import runs as R


def test_latest_and_preferred(spark):
    rows = [("r1", "m", "Q8_0", 0, 1, 0.9), ("r2", "m", "Q8_0", 0, 2, 0.1), ("r3", "m", "Q8_0", 0, 2, 0.2), ("r4", "m", "Q4_K_M", 0, 1, 0.1), ("r5", "m", "Q4_K_M", 9, 1, 0.1), ("r6", "n", None, None, None, None)]
    df = spark.createDataFrame(rows, "run_id string, model_id string, quant string, thinking_budget bigint, started_at int, full_match_accuracy double").selectExpr("*", "1 AS n")
    assert sorted(r["run_id"] for r in R.latest(df).collect()) == ["r3", "r4", "r5", "r6"]
    assert sorted(r["run_id"] for r in R.preferred(df).collect()) == ["r5", "r6"]
    assert R.latest(df.limit(0)).count() == 0


def test_badges_are_strict(spark):
    rows = [(0.30, 0.20, 0.05, 0.7), (0.31, 0.21, 0.06, 0.9), (0.0, 0.0, 0.0, 0.71)]
    df = spark.createDataFrame(rows, "m double, g double, l double, f double")
    assert [r[0] for r in df.select(R.badges(*map(F.col, "mglf"))).collect()] == [["mid"], ["over-rejects", "ghost-prone", "leaks-few-shot"], ["clean"]]


def test_interleaved(spark):
    rows = [(k, "null" if k % 3 == 0 else "x") for k in range(1, 30)] + [(40, None), (41, " null ")]
    df = spark.createDataFrame(rows, "sample_id bigint, target string")
    assert [r["sample_id"] for r in R.interleaved(df, 6).collect()] == [1, 3, 2, 6, 4, 9]
    assert R.interleaved(df.where("target = 'x'"), 3).count() == 3 and R.interleaved(df.limit(0)).count() == 0


def test_names_and_sizes(spark):
    df = spark.createDataFrame([("a__b-Q4_K_M.gguf", 131072), ("x-IQ4_XS.gguf", None), ("x-Q8_0.gguf", 10), ("x-BF16.gguf", 1), ("x.gguf", 1), (None, 1)], "p string, n bigint")
    got = [tuple(r) for r in df.select(R.quant_of(F.col("p")), R.context_size(F.col("n"))).collect()]
    assert got == [("Q4_K_M", 32768), ("IQ4_XS", 32768), ("Q8_0", 10), ("BF16", 1), ("?", 1), ("?", 1)]
    assert df.select(R.model_of(R.slug(F.lit("a/b")))).first()[0] == "a/b"
    assert df.select(R.context_size(F.col("n"), F.lit(5))).first()[0] == 5


def test_thinking_parts(spark):
    df = spark.createDataFrame([(" <think> a\nb </think> c ",), ("x <think>a</think>",), ("<think>open",), (None,)], "r string")
    thought, said = R.thinking_parts(F.col("r"))
    got = [tuple(r) for r in df.select(thought, said).collect()]
    assert got == [("a\nb", "c"), ("", "x <think>a</think>"), ("", "<think>open"), ("", None)]


def test_compare_multiplies(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "doc_id int, v string")
    assert R.compare(a, a, "doc_id", ["v"], ("_a", "_b")).count() == 5


def test_gaps(spark):
    ids = [5, 6, 9, 9, 1_000_000, 1_000_001, 3_000_000, None]
    df = spark.createDataFrame([(i,) for i in ids], "id bigint")
    got = sorted((r["gap_start"], r["gap_end"], r["missing"]) for r in Q.id_gaps(df).collect())
    assert got == [(7, 8, 2), (10, 999_999, 999_990), (1_000_002, 2_999_999, 1_999_998)]
    s = Q.missing_summary(df, 3).first()
    assert (s["n_missing"], s["first_missing"]) == (2_999_990, "7,8,10")
    p = Q.id_profile(df).first()
    assert (p["n_rows"], p["distinct_ids"], p["exact_sequence"], p["contiguous"]) == (8, 6, False, False)
    assert Q.id_gaps(df.limit(0)).count() == 0
    assert Q.id_profile(spark.range(1, 4).toDF("id")).first()["exact_sequence"]
    text = spark.createDataFrame([("1",), ("x",), ("3",)], "id string")
    assert [tuple(r) for r in Q.missing_ids(text).collect()] == [(2,)]


def test_gaps_of_sparse_ids(spark):
    """Ids spread over all 64 bits: ranges hold about as many each, and no gap is lost between them."""
    rng = random.Random(1)
    ids = sorted({rng.randrange(-(2**63), 2**63) for _ in range(2000)} | {5, 6, 7, 9})
    df = spark.createDataFrame([(i,) for i in ids], "id bigint")
    want = [(a + 1, b - 1, b - a - 1) for a, b in zip(ids, ids[1:]) if b != a + 1]
    assert sorted((r["gap_start"], r["gap_end"], r["missing"]) for r in Q.id_gaps(df).collect()) == want
    both = spark.createDataFrame([(-(2**63),), (2**63 - 1,)], "id bigint")
    assert [tuple(r) for r in Q.id_gaps(both).collect()] == [(-(2**63) + 1, 2**63 - 2, None)]


def test_tally(spark):
    v = spark.createDataFrame([("b", False), ("a", False), ("c", True)], "variant string, ok boolean")
    assert tuple(R.tally(v).first()) == (1, 2, "a,b") and tuple(R.tally(v.limit(0)).first()) == (0, 0, "")


def test_stratified_draws(spark):
    rows = [(k, f"text {k % 50}", 2025 if k % 2 else 2026, "big" if k % 3 else "small") for k in range(600)] + [(9999, None, 2025, "small")]
    pool = spark.createDataFrame(rows, "id bigint, text string, year int, cat string").selectExpr("*", "1 AS seed")
    wanted = G.targets(spark, {2025: {"big": 7, "small": 1000, "none": 3}, 2026: {"big": 0}})
    a, b = ({r["id"] for r in G.stratified(pool.repartition(k), wanted).collect()} for k in (1, 7))
    assert a == b
    kinds = {}
    for r in G.stratified(pool, wanted).collect():
        kinds[r["year"], r["cat"]] = kinds.get((r["year"], r["cat"]), 0) + 1
    assert kinds == {(2025, "big"): 7, (2025, "small"): 101}
    assert {r["id"] for r in G.stratified(pool, wanted, "other seed").collect()} != a


def test_not_in_gold(spark):
    gold = spark.createDataFrame([("a" * 80 + "x",), (None,)], "sms string")
    rows = spark.createDataFrame([(1, "a" * 80 + "y"), (2, "a" * 79), (2, "a" * 79), (3, None)], "id int, text string").selectExpr("*", "1 AS sms")
    assert sorted(r["id"] for r in G.not_in_gold(rows, gold).collect()) == [2, 2, 3]
