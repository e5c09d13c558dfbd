"""Answers of models: response filters, three-valued parsing, and the accuracy metrics.

Both sides of a pair are parsed once into a kind (object, null, other, error) and a struct of variants, so that absent,
null and wrongly typed fields stay apart; all metrics are expressions over that pair in one projection.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import patterns as P
from marlstone.functions.text import collapse, let, strip

FIELDS = ("amount", "counterparty", "type", "account")
_SCALAR = r'(?s)^(?:-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|NaN|-?Infinity|"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")$'


# ---- filters

def first_response(resps: Column) -> Column:
    return F.try_element_at(F.try_element_at(resps, F.lit(1)), F.lit(1))


def without_thinking(response: Column) -> Column:
    return strip(F.regexp_replace(strip(response), r"(?s)<think>.*?</think>", ""))


def extract_json(response: Column) -> Column:
    """``null`` if the answer begins so, else its first braces up to the first closing one, else all of it."""
    return let(without_thinking(response), lambda r: let(F.regexp_extract(r, r"(?s)\{.*?\}", 0), lambda braces: F.when(F.startswith(F.lower(r), F.lit("null")), "null").when(braces != "", braces).otherwise(r)))


def extract_json_nonnull(response: Column) -> Column:
    """``extract_json``, and ``null`` for an object that lacks a required field."""

    def checked(r: Column, p: Column) -> Column:
        missing = F.lit(False)
        for f in P.REQUIRED_FIELDS:
            missing = missing | nullish(p["v"][f])
        return F.when((p["kind"] == "object") & missing, "null").otherwise(r)

    return let(extract_json(response), lambda r: let(parsed(r), lambda p: checked(r, p)))


FILTERS: dict[str, Callable[[Column], Column]] = {"extract_json": extract_json, "extract_json_nonnull": extract_json_nonnull}


# ---- parsing

def parsed(text: Column) -> Column:
    """``struct<kind, v struct<amount, counterparty, type, account variant>>``; a null text is an error."""
    read = lambda t: F.from_json(t, "amount variant, counterparty variant, type variant, account variant, _c string", {"allowSingleQuotes": "false", "columnNameOfCorruptRecord": "_c"})
    # Bound values: else each metric that names a field would parse the text again.
    return let(strip(text), lambda t: let(read(t), lambda v: _kind_and_fields(t, v)))


def _kind_and_fields(t: Column, v: Column) -> Column:
    is_object = v.isNotNull() & v["_c"].isNull() & t.startswith("{")
    is_other = t.rlike(_SCALAR) | (t.rlike(r"(?s)^\[.*\]$") & F.try_parse_json(t).isNotNull())
    kind = F.when(F.lower(t) == "null", "null").when(is_object, "object").when(is_other, "other").otherwise("error")
    return F.struct(kind.alias("kind"), v.alias("v"))


def absent(v: Column) -> Column:
    """JSON null or not there."""
    return v.isNull() | F.coalesce(F.is_variant_null(v), F.lit(False))


def as_string(v: Column) -> Column:
    """The text of a JSON string; null for every other type."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def spelled(v: Column) -> Column:
    """Any value as text, as it is compared."""
    return F.try_variant_get(v, "$", "string")


def nullish(v: Column) -> Column:
    return absent(v) | F.coalesce(F.lower(strip(as_string(v))) == "null", F.lit(False))


# ---- normalisers and matchers

def account_key(v: Column) -> Column:
    """``card:1234`` or ``account:1234``: the last four of the last run of three digits or more; null without one."""
    s = as_string(v) if not isinstance(v, str) else v
    return account_key_of(s)


def account_key_of(s: Column) -> Column:
    runs = F.filter(F.regexp_extract_all(s, F.lit(r"(?U)(\d+)"), F.lit(1)), lambda x: F.length(x) >= 3)
    last = F.right(F.try_element_at(runs, F.lit(-1)), F.lit(4))
    return F.concat(F.when(F.lower(s).contains("card"), "card:").otherwise("account:"), last)


def type_key(v: Column) -> Column:
    return F.lower(strip(as_string(v)))


def amounts_match(a: Column, b: Column) -> Column:
    x, y = F.try_variant_get(a, "$", "double"), F.try_variant_get(b, "$", "double")
    return F.coalesce(F.abs(x - y) < 0.01, F.lit(False))


def counterparties_match_text(a: Column, b: Column) -> Column:
    """Equal but for case and white space, or the shorter, of three characters at least, inside the longer."""
    x, y = collapse(F.lower(strip(a))), collapse(F.lower(strip(b)))
    inside = F.when(F.length(x) <= F.length(y), (F.length(x) >= 3) & y.contains(x)).otherwise((F.length(y) >= 3) & x.contains(y))
    return F.when(a.isNull() & b.isNull(), True).when(a.isNull() | b.isNull(), False).otherwise((x == y) | inside)


def counterparties_match(a: Column, b: Column) -> Column:
    return F.when(absent(a) & absent(b), True).when(absent(a) | absent(b), False).otherwise(F.coalesce(counterparties_match_text(spelled(a), spelled(b)), F.lit(False)))


# ---- metrics over (reference, prediction), both from ``parsed``

def _accuracy(r: Column, p: Column, inner: Column) -> Column:
    """An unreadable prediction counts 0, agreeing nulls 1, one null 0, values that are no objects 0."""
    value = (
        F.when(p["kind"] == "error", 0.0)
        .when((r["kind"] == "null") & (p["kind"] == "null"), 1.0)
        .when((r["kind"] == "null") | (p["kind"] == "null"), 0.0)
        .when((r["kind"] != "object") | (p["kind"] != "object"), 0.0)
    )
    return value.otherwise(inner)


def _as_number(flag: Column) -> Column:
    return F.when(flag, 1.0).otherwise(0.0)


def _accounts_agree(a: Column, b: Column) -> Column:
    return F.when(absent(a) & absent(b), True).when(absent(a) | absent(b), False).otherwise(F.coalesce(account_key(a) == account_key(b), F.lit(False)))


def _same_text(a: Column, b: Column) -> Column:
    return F.when(absent(a) & absent(b), True).when(absent(a) | absent(b), False).otherwise(F.coalesce(F.lower(strip(spelled(a))) == F.lower(strip(spelled(b))), F.lit(False)))


def json_validity(r: Column, p: Column) -> Column:
    return _as_number(p["kind"] != "error")


def rejection_accuracy(r: Column, p: Column) -> Column:
    return F.when(p["kind"] == "error", 0.0).otherwise(_as_number((r["kind"] == "null") == (p["kind"] == "null")))


def field_accuracy(r: Column, p: Column) -> Column:
    same = sum((_as_number(_same_text(r["v"][f], p["v"][f])) for f in ("counterparty", "type", "account")), F.lit(0.0))
    return _accuracy(r, p, same / 3)


def amount_accuracy(r: Column, p: Column) -> Column:
    return _accuracy(r, p, _as_number(amounts_match(r["v"]["amount"], p["v"]["amount"])))


def type_accuracy(r: Column, p: Column) -> Column:
    return _accuracy(r, p, _as_number(type_key(r["v"]["type"]).eqNullSafe(type_key(p["v"]["type"]))))


def account_accuracy(r: Column, p: Column) -> Column:
    return _accuracy(r, p, _as_number(_accounts_agree(r["v"]["account"], p["v"]["account"])))


def counterparty_accuracy(r: Column, p: Column) -> Column:
    return _accuracy(r, p, _as_number(counterparties_match(r["v"]["counterparty"], p["v"]["counterparty"])))


def ghost_transaction_rate(r: Column, p: Column) -> Column:
    return _as_number((r["kind"] == "null") & (p["kind"] == "object"))


def missed_transaction_rate(r: Column, p: Column) -> Column:
    return _as_number((r["kind"] != "null") & (p["kind"] == "null"))


def full_match_accuracy(r: Column, p: Column) -> Column:
    a, b = r["v"], p["v"]
    all_four = (
        amounts_match(a["amount"], b["amount"])
        & type_key(a["type"]).eqNullSafe(type_key(b["type"]))
        & _accounts_agree(a["account"], b["account"])
        & counterparties_match(a["counterparty"], b["counterparty"])
    )
    return _accuracy(r, p, _as_number(all_four))


#: Exemplars of the prompt: sender, message, answer. A parameter; these are invented.
EXEMPLARS = [
    ("VM-LUMBNK", "Rs.450.00 debited from A/c XX1881 for Quillstone Books on 02-03-25. Ref 611102233445.", '{"amount": 450.0, "counterparty": "Quillstone Books", "type": "debit", "account": "A/c XX1881"}'),
    ("AD-BRTWEL", "INR 1,299 spent on Brightwell Card x7719 at Halcyon Footwear on 5 Apr.", '{"amount": 1299, "counterparty": "Halcyon Footwear", "type": "debit", "account": "Card x7719"}'),
    ("AX-PINNOK", "Money in! Rs 75.5 credited to a/c *2008 from VPA wrenshop@oklum.", '{"amount": 75.5, "counterparty": "wrenshop@oklum", "type": "credit", "account": "a/c *2008"}'),
    ("TM-NQUAYB", "ATM cash of Rs 2000 withdrawn with card XX3433.", '{"amount": 2000, "counterparty": null, "type": "debit", "account": "card XX3433"}'),
    ("JD-TESSEL", "897643 is the OTP for Rs 80 at Marlow Cafe.", "null"),
    ("VK-KAVOKA", "Flat 20% off at Oakmere Sports till Sunday.", "null"),
    ("AX-JAKARU", "Your statement for card X1312 is ready.", "null"),
]


def signatures(exemplars: list[tuple[str, str, str]] = EXEMPLARS) -> Column:
    """The (amount, counterparty, account) of each exemplar that is a transaction, as an array literal."""
    each = []
    for _, _, answer in exemplars:
        if answer != "null":
            each.append(signature(parsed(F.lit(answer))["v"]))
    return F.array(*each)


def signature(v: Column) -> Column:
    """Amounts count only if they are JSON numbers; empty counterparties are none."""
    number = F.when(~F.coalesce(F.schema_of_variant(v["amount"]) == "STRING", F.lit(False)), F.try_variant_get(v["amount"], "$", "double"))
    who = F.lower(strip(spelled(v["counterparty"])))
    return F.struct(number.alias("a"), F.nullif(who, F.lit("")).alias("c"), account_key(v["account"]).alias("n"))


def few_shot_leakage_rate(r: Column, p: Column, exemplars: list[tuple[str, str, str]] = EXEMPLARS) -> Column:
    mine = signature(p["v"])
    hit = F.exists(signatures(exemplars), lambda s: s["a"].eqNullSafe(mine["a"]) & s["c"].eqNullSafe(mine["c"]) & s["n"].eqNullSafe(mine["n"]))
    return _as_number((r["kind"] == "null") & (p["kind"] == "object") & hit)


#: name: (expression, aggregation, higher is better)
METRICS: dict[str, tuple[Callable[[Column, Column], Column], str, bool]] = {
    "json_validity": (json_validity, "mean", True),
    "rejection_accuracy": (rejection_accuracy, "mean", True),
    "field_accuracy": (field_accuracy, "mean", True),
    "amount_accuracy": (amount_accuracy, "mean", True),
    "type_accuracy": (type_accuracy, "mean", True),
    "account_accuracy": (account_accuracy, "mean", True),
    "counterparty_accuracy": (counterparty_accuracy, "mean", True),
    "ghost_transaction_rate": (ghost_transaction_rate, "mean", False),
    "missed_transaction_rate": (missed_transaction_rate, "mean", False),
    "full_match_accuracy": (full_match_accuracy, "mean", True),
    "few_shot_leakage_rate": (few_shot_leakage_rate, "mean", False),
}


def scored(pairs: DataFrame, target: str = "target", prediction: str = "prediction", keep: tuple[str, ...] = ()) -> DataFrame:
    """``pairs`` with the eleven metrics; each side is parsed once."""
    p = pairs.select(*keep, parsed(F.col(target)).alias("_r"), parsed(F.col(prediction)).alias("_p"))
    return p.select(*keep, *(f(F.col("_r"), F.col("_p")).alias(n) for n, (f, _, _) in METRICS.items()))


def filtered_pairs(samples: DataFrame) -> DataFrame:
    """``(sample_id, run_id, doc_id, filter, target, prediction)``: each answer through each filter."""
    raw = first_response(F.col("resps"))
    each = F.array(*(F.struct(F.lit(n).alias("filter"), f(raw).alias("prediction")) for n, f in FILTERS.items()))
    return samples.select("sample_id", "run_id", "doc_id", "target", F.explode(each).alias("x")).select("sample_id", "run_id", "doc_id", "x.filter", "target", "x.prediction")


def run_metrics(samples: DataFrame) -> DataFrame:
    """The mean of each metric for each run and filter, over all of its samples."""
    s = scored(filtered_pairs(samples), keep=("run_id", "filter"))
    return s.groupBy("run_id", "filter").agg(F.count("*").alias("n_samples"), *(F.round(F.avg(m), 6).alias(m) for m in METRICS))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, std, min, quartiles (interpolated, exact) and max of each column."""
    each = F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).alias("v")) for c in columns))
    q = lambda p: F.round(F.percentile("v", F.lit(p)), 6)
    long = df.select(F.explode(each).alias("x")).select("x.metric", "x.v")
    return long.groupBy("metric").agg(
        F.count("v").alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_samp("v"), 6).alias("std"), F.min("v").alias("min"),
        q(0.25).alias("p25"), q(0.5).alias("p50"), q(0.75).alias("p75"), F.max("v").alias("max"),
    )


def grammar_ok(answer: Column) -> Column:
    """Whether an answer is ``null`` or the four fields in their order."""
    return F.coalesce(answer.rlike(P.GRAMMAR), F.lit(False))
