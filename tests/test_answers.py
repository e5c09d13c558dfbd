import json
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone.operators import answers as A

TXN = {"amount": 83.81, "counterparty": "Oak Shop", "type": "debit", "account": "Card XX2443"}
J = json.dumps


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column).first()[0]


@pytest.mark.parametrize(
    "a,want",
    [("XX2443", "account:2443"), ("XXXXXXX7902", "account:7902"), ("A/cXX6254", "account:6254"), ("A/c 12XX6254", "account:6254"), ("a/c *914", "account:914"), ("Card XX2443", "card:2443"), ("card ending 2443", "card:2443"), ("CARD 98762443", "card:2443"), ("A/c 12", None), ("", None)],
)
def test_account_keys(spark, a, want):
    assert one(spark, A.account_key_of(F.col("a")), a=a) == want
    if want and want.startswith("card"):
        assert one(spark, A.account_key_of(F.col("a")), a=a.lower().replace("card", "a/c")) == want.replace("card", "account")


@pytest.mark.parametrize(
    "a,b,want",
    [("Oak Shop", "Oak Shop", True), ("OAK shop", "oak SHOP", True), ("Oak  Shop", "Oak Shop", True), ("VPA oak@pay", "oak@pay", True), ("mobile 9XX123-BANKING", "9XX123", True), ("UPI-55-Compass", "Compass", True), ("Oak Shop MUMBAI", "Oak Shop", True), (None, None, True), (None, "x", False), ("x", None, False), ("9XX124", "9XX123", False), ("Oka Shop", "Oak Shop", False), ("ab", "abc", False)],
)
def test_counterparties(spark, a, b, want):
    assert one(spark, A.counterparties_match_text(F.col("a"), F.col("b")), a=a, b=b) is want


METRIC_CASES = [
    # metric, reference, prediction, value
    ("ghost_transaction_rate", "null", J(TXN), 1.0), ("ghost_transaction_rate", "null", "null", 0.0), ("ghost_transaction_rate", J(TXN), J(TXN), 0.0),
    ("missed_transaction_rate", J(TXN), "null", 1.0), ("missed_transaction_rate", J(TXN), J(TXN), 0.0), ("missed_transaction_rate", "null", "null", 0.0),
    ("full_match_accuracy", J(TXN), J({**TXN, "account": "card ending 2443"}), 1.0), ("full_match_accuracy", J(TXN), J({**TXN, "type": "credit"}), 0.0), ("full_match_accuracy", J(TXN), J({**TXN, "amount": 84}), 0.0),
    ("full_match_accuracy", "null", "NULL ", 1.0), ("full_match_accuracy", "null", J(TXN), 0.0), ("full_match_accuracy", J(TXN), "null", 0.0),
    ("few_shot_leakage_rate", "null", A.EXEMPLARS[0][2], 1.0), ("few_shot_leakage_rate", "null", J(TXN), 0.0), ("few_shot_leakage_rate", J(TXN), A.EXEMPLARS[0][2], 0.0), ("few_shot_leakage_rate", "null", A.EXEMPLARS[3][2], 1.0),
    ("few_shot_leakage_rate", "null", A.EXEMPLARS[1][2].replace("1299", "1299.0"), 1.0), ("few_shot_leakage_rate", "null", A.EXEMPLARS[1][2].replace("1299", '"1299"'), 0.0),
    ("json_validity", "null", "", 0.0), ("json_validity", "null", "5", 1.0), ("json_validity", "null", "[1]", 1.0), ("json_validity", "null", "{'a': 1}", 0.0), ("json_validity", "null", "5 apples", 0.0), ("json_validity", "null", None, 0.0),
    ("rejection_accuracy", "null", "5", 0.0), ("rejection_accuracy", J(TXN), "5", 1.0), ("rejection_accuracy", J(TXN), "oops", 0.0),
    ("amount_accuracy", J(TXN), J({**TXN, "amount": "83.81"}), 1.0), ("amount_accuracy", J({**TXN, "amount": 1.0}), J({**TXN, "amount": 1.0099}), 1.0), ("amount_accuracy", J({**TXN, "amount": 1}), J({**TXN, "amount": 1.011}), 0.0),
    ("amount_accuracy", J(TXN), '{"amount": NaN}', 0.0), ("amount_accuracy", '{"type": "debit"}', '{"type": "debit"}', 0.0), ("amount_accuracy", J(TXN), "[1]", 0.0),
    ("type_accuracy", J(TXN), J({**TXN, "type": " DEBIT"}), 1.0), ("type_accuracy", '{"type": null}', '{"amount": 1}', 1.0),
    ("account_accuracy", J(TXN), J({**TXN, "account": "XX2443"}), 0.0), ("account_accuracy", '{"account": "none"}', '{"account": "none"}', 0.0), ("account_accuracy", '{"amount": 1}', '{"account": null}', 1.0),
    ("field_accuracy", J(TXN), J({**TXN, "counterparty": "other"}), 2 / 3), ("field_accuracy", J(TXN), '{"amount": 1}', 0.0),
    ("counterparty_accuracy", J({**TXN, "counterparty": None}), J({**TXN, "counterparty": None}), 1.0), ("counterparty_accuracy", J(TXN), '{"counterparty": "a", "counterparty": "Oak Shop"}', 1.0),
]


def test_metrics(spark):
    df = spark.createDataFrame([(k, r, p) for k, (_, r, p, _) in enumerate(METRIC_CASES)], "k int, target string, prediction string").selectExpr("*", "1 AS kind", "2 AS v")
    got = {r["k"]: r for r in A.scored(df, keep=("k",)).collect()}
    wrong = [(c, got[k][c[0]]) for k, c in enumerate(METRIC_CASES) if abs(got[k][c[0]] - c[3]) > 1e-9]
    assert wrong == []
    assert A.scored(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "raw,want",
    [("<think>a {b}</think>\n null.", "null"), ("nullify", "null"), ('x {"a": {"b": 1}} y', '{"a": {"b": 1}'), ("<think>open {x}", "{x}"), ("plain", "plain"), (" \n", ""), ('{"a":\n1}', '{"a":\n1}'), ("<think>a</think>b<think>c</think> NULL", "b NULL")],
)
def test_filter(spark, raw, want):
    assert one(spark, A.extract_json(F.col("a")), a=raw) == want


def test_nonnull_filter(spark):
    f = A.extract_json_nonnull(F.col("a"))
    assert one(spark, f, a=J({**TXN, "counterparty": None})) != "null"
    for bad in ({**TXN, "amount": None}, {**TXN, "type": " NULL "}, {"amount": 1, "type": "debit"}):
        assert one(spark, f, a=J(bad)) == "null"
    assert one(spark, f, a="[1]") == "[1]"


def python_kind(t):
    t = t.strip()
    if t.lower() == "null":
        return "null"
    try:
        return "object" if isinstance(json.loads(t), dict) else "other"
    except ValueError:
        return "error"


@settings(max_examples=25, deadline=None)
@given(st.lists(st.one_of(st.from_regex(r'\{"(amount|type)": ?(1|-0?\.5|"a"|null|\[1\]|tru|true)\}?', fullmatch=True), st.from_regex(r' ?(null|NULL|-?[0-9]{1,3}(\.[0-9])?|"a"|"|\[\]|\{\}|true|tru|nul) ?', fullmatch=True)), min_size=1, max_size=50))
def test_kinds(spark, texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", A.parsed(F.col("t"))["kind"].alias("kind"))
    assert {r["k"]: r["kind"] for r in df.collect()} == {k: python_kind(t) for k, t in enumerate(texts)}


def test_grammar(spark):
    ok = A.grammar_ok(F.col("a"))
    assert one(spark, ok, a=J(TXN)) and one(spark, ok, a="null")
    for bad in ("NULL", J({**TXN, "amount": -1}), J({**TXN, "type": "x"}), J({"amount": 1}), J(TXN) + " ", None):
        assert one(spark, ok, a=bad) is False


def test_always_null_predictor(spark):
    """Whoever always answers null matches exactly the null part, never invents and misses all the rest."""
    rows = [(k, "null" if k < 89 else J(TXN), "null") for k in range(203)]
    s = A.scored(spark.createDataFrame(rows, "k int, target string, prediction string"))
    r = s.agg(*(F.round(F.avg(m), 3).alias(m) for m in ("full_match_accuracy", "ghost_transaction_rate", "missed_transaction_rate"))).first()
    assert tuple(r) == (0.438, 0.0, 0.562)
    assert re.match("a", "a")
