"""Sender categories and the funnel that narrows messages down to completed transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import patterns as P
from marlstone.functions.text import matches, regex, strip

STAGES = ["s1_has_amount", "s2_has_account", "s3_has_verb", "s4_not_otp", "s5_not_collect"]


def not_own(sender: Column) -> Column:
    """Messages of others; a null sender stays."""
    return ~sender.eqNullSafe(F.lit(P.OWN))


def sender_category(sender: Column) -> Column:
    """The first category that the trimmed sender fits; a null or empty sender counts as text, as exports read it back."""
    s = strip(F.when(sender == "", "nan").otherwise(F.coalesce(sender, F.lit("nan"))))
    out = None
    for name, pattern in P.SENDER_CATEGORIES:
        out = F.when(s.rlike(pattern), name) if out is None else out.when(s.rlike(pattern), name)
    return out.otherwise(P.SENDER_OTHERS)


def commercial(messages: DataFrame) -> DataFrame:
    """Messages of others that no mobile number sent, with ``sender_category``."""
    return messages.where(not_own(F.col("sender"))).withColumn("sender_category", sender_category(F.col("sender"))).where(F.col("sender_category") != "Mobile Number")


def stages_passed(text: Column, old: bool = False) -> Column:
    """How many stages a text passes in a row, 0 to 5; each pattern is tried at most once, and only if all before it held.

    A null text passes none.
    """
    found = lambda p: F.coalesce(text.rlike(regex(p)), F.lit(False))
    fails = [~matches(text, P.AMOUNT), ~matches(text, P.ACCOUNT), ~matches(text, P.VERB_OLD if old else P.VERB), found(P.OTP), found(P.COLLECT)]
    out = F.when(fails[0], 0)
    for k, f in enumerate(fails[1:], 1):
        out = out.when(f, k)
    return out.otherwise(len(fails))


def funnel(messages: DataFrame, old: bool = False) -> DataFrame:
    """Commercial messages with the five cumulative flags; false, never null, from the first stage that fails."""
    c = commercial(messages)
    deep = c.withColumn("_passed", stages_passed(F.col("text"), old))
    return deep.select(*c.columns, *((F.col("_passed") > k).alias(s) for k, s in enumerate(STAGES)))


def stage_counts(flagged: DataFrame) -> DataFrame:
    """``(stage, retained, dropped, percent)``: dropped against the stage before, per cent of all commercial rows.

    One pass and one small shuffle whatever the number of stages. An empty input gives zeros and null per cents.
    """
    totals = flagged.agg(F.count("*").alias("total"), *(F.count_if(s).alias(s) for s in STAGES))
    rows = F.array(
        *(F.struct(F.lit(s).alias("stage"), F.col(s).alias("retained"), ((F.col(STAGES[k - 1]) if k else F.col("total")) - F.col(s)).alias("dropped")) for k, s in enumerate(STAGES))
    )
    percent = F.when(F.col("total") > 0, F.round(F.lit(100.0) * F.col("x.retained") / F.col("total"), 2))
    return totals.select("total", F.explode(rows).alias("x")).select("x.stage", "x.retained", "x.dropped", percent.alias("percent"))


def stage_splits(flagged: DataFrame) -> DataFrame:
    """Each row once for each stage, with ``split``: kept by all stages so far, or failed one of them."""
    each = F.array(*(F.struct(F.lit(s).alias("stage"), F.col(s).alias("kept")) for s in STAGES))
    return flagged.withColumn("x", F.explode(each)).select(*(c for c in flagged.columns), F.col("x.stage").alias("stage"), F.when(F.col("x.kept"), "likely_transactions").otherwise("non_transactions").alias("split"))


def write_splits(flagged: DataFrame, path: str) -> None:
    """All ten outputs in one pass over the rows."""
    stage_splits(flagged).write.mode("overwrite").partitionBy("stage", "split").parquet(path)


def financial(text: Column) -> Column:
    """Whether any financial hint occurs; false for null."""
    out = F.lit(False)
    for p in P.FINANCIAL:
        out = out | matches(text, p)
    return out


def incoming(messages: DataFrame) -> DataFrame:
    return messages.where(~F.col("is_from_me") & (F.col("text") != ""))
