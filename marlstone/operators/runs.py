"""The catalogue of runs: latest and preferred ones, leaderboard, badges, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import patterns as P
from marlstone.functions.text import one_line, strip, truncate
from marlstone.operators.answers import METRICS
from marlstone.session import bounded_broadcast

TIE = 1e-9


def quant_of(path: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(path, P.QUANT, 1), F.lit("")), F.lit("?"))


def slug(model_id: Column) -> Column:
    return F.replace(model_id, F.lit("/"), F.lit("__"))


def model_of(slug_: Column) -> Column:
    return F.replace(slug_, F.lit("__"), F.lit("/"))


def context_size(native: Column, asked: Column | None = None) -> Column:
    """What is asked for, else the native size up to the cap, else the cap."""
    capped = F.least(F.coalesce(native, F.lit(P.CONTEXT_CAP)), F.lit(P.CONTEXT_CAP))
    return capped if asked is None else F.coalesce(asked, capped)


def latest(runs: DataFrame) -> DataFrame:
    """The latest run of each model, quantisation and budget; of equal times the greater id."""
    return runs.withColumn("_n", F.row_number().over(Window.partitionBy("model_id", "quant", "thinking_budget").orderBy(F.desc("started_at"), F.desc("run_id")))).where("_n = 1").drop("_n")


def preferred(runs: DataFrame) -> DataFrame:
    """One run for each model: Q4_K_M first, then the larger budget, then the better full match, then the lower id."""
    order = [(F.col("quant") != "Q4_K_M").asc(), F.desc("thinking_budget"), F.desc("full_match_accuracy"), F.asc("run_id")]
    return runs.withColumn("_n", F.row_number().over(Window.partitionBy("model_id").orderBy(*order))).where("_n = 1").drop("_n")


def badges(missed: Column, ghost: Column, leakage: Column, full: Column) -> Column:
    found = F.array_compact(F.array(F.when(missed > 0.30, "over-rejects"), F.when(ghost > 0.20, "ghost-prone"), F.when(leakage > 0.05, "leaks-few-shot")))
    return F.when(F.size(found) > 0, found).when(full > 0.7, F.array(F.lit("clean"))).otherwise(F.array(F.lit("mid")))


def leaderboard(catalogue: DataFrame) -> DataFrame:
    """Runs with badges, ``best`` and ``worst`` metric names and a rank by full match; best wins over worst in a tie.

    The extremes are one row, joined by broadcast: proven to be one.
    """
    names = list(METRICS)
    ends = catalogue.agg(*(F.max(m).alias(f"{m}_hi") for m in names), *(F.min(m).alias(f"{m}_lo") for m in names))
    joined = catalogue.crossJoin(F.broadcast(ends))
    best, worst = [], []
    for m in names:
        top, bottom = (f"{m}_hi", f"{m}_lo") if METRICS[m][2] else (f"{m}_lo", f"{m}_hi")
        is_best = F.abs(F.col(m) - F.col(top)) < TIE
        best.append(F.when(is_best, m))
        worst.append(F.when(~is_best & (F.abs(F.col(m) - F.col(bottom)) < TIE), m))
    rank = F.row_number().over(Window.orderBy(F.desc("full_match_accuracy"), "model_id", "quant", "thinking_budget", "run_id"))
    badge = badges(F.col("missed_transaction_rate"), F.col("ghost_transaction_rate"), F.col("few_shot_leakage_rate"), F.col("full_match_accuracy"))
    return joined.select(*catalogue.columns, rank.alias("rank"), badge.alias("badges"), F.array_compact(F.array(*best)).alias("best"), F.array_compact(F.array(*worst)).alias("worst"))


def interleaved(samples: DataFrame, k: int = 8) -> DataFrame:
    """The first ``k`` samples, transactions and nulls by turns in their order."""
    is_null = F.coalesce(strip(F.col("target")), F.lit("")) == "null"
    # Only the first k of either kind can be chosen: cut before numbering, so that no window sees all samples.
    real = samples.where(~is_null).orderBy("sample_id").limit(k).withColumn("kind", F.lit(0))
    null = samples.where(is_null).orderBy("sample_id").limit(k).withColumn("kind", F.lit(1))
    turn = F.row_number().over(Window.partitionBy("kind").orderBy("sample_id"))
    return real.unionByName(null).withColumn("turn", turn).orderBy("turn", "kind").limit(k)


def compare(a: DataFrame, b: DataFrame, on: str, columns: list[str], suffixes: tuple[str, str]) -> DataFrame:
    """Two outputs side by side; repeated keys multiply, as a join does."""
    named = lambda d, s: d.select(on, *(F.col(c).alias(f"{c}{s}") for c in columns))
    return named(a, suffixes[0]).join(named(b, suffixes[1]), on)


def last_write(samples: DataFrame) -> DataFrame:
    """The last sample of each run and document."""
    row = F.max_by(F.struct(*samples.columns), "sample_id")
    return samples.groupBy(F.col("run_id").alias("_r"), F.col("doc_id").alias("_d")).agg(row.alias("x")).select("x.*")


def thinking_parts(response: Column) -> tuple[Column, Column]:
    """The thinking block at the start, trimmed, and what comes after it."""
    p = r"(?s)^\s*<think>(.*?)</think>(.*)$"
    has = response.rlike(p)
    return F.when(has, strip(F.regexp_extract(response, p, 1))).otherwise(""), F.when(has, strip(F.regexp_extract(response, p, 2))).otherwise(strip(response))


def viewer(docs: DataFrame, runs: DataFrame, samples: DataFrame) -> DataFrame:
    """Each chosen document against each run: the last sample's verdict, or ``(no sample)``.

    ``docs`` and ``runs`` are the viewer's few choices; their grid is the feature.
    """
    grid = bounded_broadcast(docs.select("doc_id").distinct()).crossJoin(bounded_broadcast(runs.select("run_id", "model_id")))
    s = last_write(samples.join(bounded_broadcast(docs.select("doc_id").distinct()), "doc_id", "left_semi"))
    raw = F.try_element_at(F.try_element_at("resps", F.lit(1)), F.lit(1))
    thought, said = thinking_parts(raw)
    mark = F.when(F.col("full_match_accuracy") >= 0.999, "match").otherwise("miss")
    cells = s.select("doc_id", "run_id", mark.alias("verdict"), truncate(thought, 600).alias("thinking"), truncate(one_line(said), 250, "").alias("answer"))
    return grid.join(cells, ["doc_id", "run_id"], "left").select("doc_id", "run_id", "model_id", F.coalesce("verdict", F.lit("(no sample)")).alias("verdict"), "thinking", "answer")


def sweep(models: DataFrame, quants: DataFrame, budgets: DataFrame, weights: DataFrame) -> DataFrame:
    """Models by quantisations, by budgets too for thinking models, as far as their weights are there.

    The inputs are short configuration tables; their product is the feature.
    """
    plan = models.crossJoin(F.broadcast(quants)).join(weights.select("model_id", "quant"), ["model_id", "quant"], "left_semi")
    with_budget = plan.where("thinking").crossJoin(F.broadcast(budgets.select("thinking_budget")))
    return with_budget.unionByName(plan.where("NOT thinking").withColumn("thinking_budget", F.lit(0).cast("long")))


def tally(variants: DataFrame) -> DataFrame:
    """``(passed, failed, failed_variants)`` of ``(variant, ok)``; variants are a configuration, so their names fit a row."""
    failed = F.array_join(F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("variant")))), ",")
    return variants.agg(F.count_if("ok").alias("passed"), F.count_if(~F.col("ok")).alias("failed"), failed.alias("failed_variants"))
