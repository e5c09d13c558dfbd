import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone.functions import patterns as P
from marlstone.functions.text import html_escape, sanitised, strip, truncate
from marlstone.operators.funnel import STAGES, financial, funnel, sender_category, stage_counts, stage_splits, write_splits
from marlstone.session import scratch

TEXTS = [
    "Rs.500 debited from a/c XX1234", "rs 5 spent on card 1234", "500 INR paid by card ending x12", "INR 5", "hours, we", "otp 1 for rs 5 debited a/c x1",
    "has requested money rs. 5 debited a/c x1", "Rs 5 a/c *1 has a debit by transfer", "debitedàSBI Rs 5 a/c x12", "Rs 5 debited a/c x१२", None, "", "₹5 a/c xx1 without OTP", "rs 5 a/c x1 auto-debit done",
]


def python_flags(text, verb=P.VERB):
    f = lambda p: bool(re.search(p, text, re.I)) if text is not None else False
    s1 = f(P.AMOUNT)
    s2 = s1 and f(P.ACCOUNT)
    s3 = s2 and f(verb)
    s4 = s3 and not f(P.OTP)
    return [s1, s2, s3, s4, s4 and not f(P.COLLECT)]


@pytest.mark.parametrize("old", [False, True])
def test_flags_follow_the_patterns(spark, old):
    df = spark.createDataFrame([(k, "VM-LUMBNK", t) for k, t in enumerate(TEXTS)], "id int, sender string, text string")
    got = {r["id"]: [r[s] for s in STAGES] for r in funnel(df, old).collect()}
    assert got == {k: python_flags(t, P.VERB_OLD if old else P.VERB) for k, t in enumerate(TEXTS)}


@pytest.mark.parametrize(
    "sender,want",
    [("+915555000001", "Mobile Number"), ("5555000001", "Mobile Number"), ("56012", "Numeric Shortcode"), ("12", "Others"), ("VM-LUMBNK", "Commercial/Brand (Prefixed)"), (" VM-X ", "Commercial/Brand (Prefixed)"), ("Fepiho", "Commercial/Brand (Textual)"), (None, "Commercial/Brand (Textual)"), ("", "Commercial/Brand (Textual)"), ("!!", "Others"), ("+1234567890123456", "Others")],
)
def test_sender_category(spark, sender, want):
    assert spark.createDataFrame([(sender,)], "s string").select(sender_category(F.col("s"))).first()[0] == want


def test_counts_are_consistent(spark):
    rows = [(k, [None, "me", "+915555000001", "56012"][k % 4], TEXTS[k % len(TEXTS)]) for k in range(400)]
    df = spark.createDataFrame(rows, "id int, sender string, text string").selectExpr("*", "1 AS stage", "2 AS sender_category_")
    f = funnel(df)
    counts = [tuple(r) for r in stage_counts(f).collect()]
    total = f.count()
    assert total == 200
    before = total
    for _, kept, dropped, percent in counts:
        assert kept + dropped == before and percent == round(100 * kept / total, 2)
        before = kept
    empty = stage_counts(funnel(df.limit(0))).collect()
    assert [(r["retained"], r["dropped"], r["percent"]) for r in empty] == [(0, 0, None)] * 5
    path = scratch(spark, "splits")
    write_splits(f.drop("stage"), path)
    back = spark.read.parquet(path).groupBy("stage", "split").count().collect()
    assert sum(r["count"] for r in back) == 5 * total == stage_splits(f.drop("stage")).count()


def test_financial(spark):
    df = spark.createDataFrame([("global",), ("hello",), (None,), ("UPI",), ("x" * 100_000 + " loan",)], "t string")
    assert [r[0] for r in df.select(financial(F.col("t"))).collect()] == [True, False, False, True, True]


def test_text_helpers(spark):
    df = spark.createDataFrame([("  a ", "a\x00b\x0bc퟿😀", "<a href='x'>&\"", "é" * 5)], "s string, x string, h string, t string")
    r = sanitised(df).select(strip(F.col("s")), "x", html_escape(F.col("h")), truncate(F.col("t"), 3)).first()
    assert tuple(r) == ("a", "abc퟿😀", "&lt;a href=&#x27;x&#x27;&gt;&amp;&quot;", "ééé…")


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("rs.₹ 1,2a/cXx*debited otp १"), max_size=40), min_size=1, max_size=40))
def test_flags_property(spark, texts):
    df = spark.createDataFrame([(k, "56012", t) for k, t in enumerate(texts)], "id int, sender string, text string")
    got = {r["id"]: [r[s] for s in STAGES] for r in funnel(df).collect()}
    assert got == {k: python_flags(t) for k, t in enumerate(texts)}
