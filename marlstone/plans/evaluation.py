"""Queries over answers, metrics and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import patterns as P
from marlstone.operators import answers as A
from marlstone.operators import predict as M
from marlstone.operators import runs as R
from marlstone.plans.sqltext import collapse, lit, strip
from marlstone.session import table
from marlstone.sources import files

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# ---- SQL over answers -----------------------------------------------------------------------------------------------

_RAW = "resps[1][1]"


def _without_thinking(x: str) -> str:
    return strip(f"regexp_replace({strip(x)}, '<think>.*?</think>', '', 'gs')")


def _extract_json(x: str) -> str:
    r = _without_thinking(x)
    return f"CASE WHEN starts_with(lower({r}), 'null') THEN 'null' WHEN regexp_matches({r}, '\\{{.*?\\}}', 's') THEN regexp_extract({r}, '\\{{.*?\\}}', 0, 's') ELSE {r} END"


def _kind(x: str) -> str:
    return f"CASE WHEN lower({strip(x)}) = 'null' THEN 'null' WHEN {x} IS NOT NULL AND {strip(x)} <> '' AND json_valid({strip(x)}) THEN CASE WHEN json_type({strip(x)}) = 'OBJECT' THEN 'object' ELSE 'other' END ELSE 'error' END"


#: One row for each side of a pair: kind, and each field as text with its JSON type.
def _side(x: str, kind: str, s: str) -> str:
    j = f"CASE WHEN {kind} = 'object' THEN {strip(x)} END"
    out = []
    for f in A.FIELDS:
        out += [f"coalesce(json_type({j}, '$.{f}'), 'NULL') AS {s}_{f}_t", f"json_extract_string({j}, '$.{f}') AS {s}_{f}"]
    return ", ".join(out)


_ANSWERS = f"SELECT sample_id, run_id, doc_id, target, {_RAW} AS raw, {_extract_json(_RAW)} AS p1 FROM samples"
_NULLISH = lambda f: f"(coalesce(json_type({strip('p1')}, '$.{f}'), 'NULL') = 'NULL' OR lower({strip(f'''json_extract_string({strip('p1')}, '$.{f}')''')}) = 'null')"
_NONNULL = f"CASE WHEN pk = 'object' AND ({' OR '.join(_NULLISH(f) for f in P.REQUIRED_FIELDS)}) THEN 'null' ELSE p1 END"
_FILTERED = (
    f"a AS MATERIALIZED ({_ANSWERS}), k AS MATERIALIZED (SELECT *, {_kind('p1')} AS pk FROM a), "
    f"b AS MATERIALIZED (SELECT *, {_NONNULL} AS p2 FROM k), "
    "u AS MATERIALIZED (SELECT sample_id, run_id, doc_id, target, 'extract_json' AS filter, p1 AS prediction FROM b UNION ALL SELECT sample_id, run_id, doc_id, target, 'extract_json_nonnull', p2 FROM b)"
)


def _account(s: str) -> str:
    runs = f"list_filter(regexp_extract_all({s}_account, '\\p{{Nd}}+'), lambda x: length(x) >= 3)"
    return f"CASE WHEN {s}_account_t = 'VARCHAR' THEN CASE WHEN contains(lower({s}_account), 'card') THEN 'card:' ELSE 'account:' END || right(list_last({runs}), 4) END"


def _scored(pairs: str, keep: str) -> str:
    """All metrics over ``pairs`` with ``target`` and ``prediction``."""
    side = f"SELECT *, {_kind('target')} AS rk, {_kind('prediction')} AS pk FROM {pairs}"
    fields = f"SELECT *, {_side('target', 'rk', 'r')}, {_side('prediction', 'pk', 'p')} FROM s"
    typ = lambda s: f"CASE WHEN {s}_type_t = 'VARCHAR' THEN lower({strip(f'{s}_type')}) END"
    absent = lambda s, f: f"({s}_{f}_t = 'NULL')"
    same = lambda f: f"CASE WHEN {absent('r', f)} AND {absent('p', f)} THEN 1.0 WHEN {absent('r', f)} OR {absent('p', f)} THEN 0.0 WHEN lower({strip(f'r_{f}')}) = lower({strip(f'p_{f}')}) THEN 1.0 ELSE 0.0 END"
    amount = "coalesce(abs(try_cast(r_amount AS DOUBLE) - try_cast(p_amount AS DOUBLE)) < 0.01, false)"
    account = f"CASE WHEN {absent('r', 'account')} AND {absent('p', 'account')} THEN true WHEN {absent('r', 'account')} OR {absent('p', 'account')} THEN false ELSE coalesce({_account('r')} = {_account('p')}, false) END"
    x, y = collapse(f"lower({strip('r_counterparty')})"), collapse(f"lower({strip('p_counterparty')})")
    who = (
        f"CASE WHEN {absent('r', 'counterparty')} AND {absent('p', 'counterparty')} THEN true WHEN {absent('r', 'counterparty')} OR {absent('p', 'counterparty')} THEN false "
        f"ELSE {x} = {y} OR (length({x}) <= length({y}) AND length({x}) >= 3 AND contains({y}, {x})) OR (length({x}) > length({y}) AND length({y}) >= 3 AND contains({x}, {y})) END"
    )
    kind_same = f"({typ('r')}) IS NOT DISTINCT FROM ({typ('p')})"
    acc = lambda inner: f"CASE WHEN pk = 'error' THEN 0.0 WHEN rk = 'null' AND pk = 'null' THEN 1.0 WHEN rk = 'null' OR pk = 'null' THEN 0.0 WHEN rk <> 'object' OR pk <> 'object' THEN 0.0 ELSE {inner} END"
    num = lambda c: f"CASE WHEN {c} THEN 1.0 ELSE 0.0 END"
    sig = []
    for _, _, answer in A.EXEMPLARS:
        if answer != "null":
            j = lit(answer)
            e = f"json_extract_string({j}, '$.account')"
            runs = f"list_filter(regexp_extract_all({e}, '[0-9]+'), lambda x: length(x) >= 3)"
            key = f"(CASE WHEN contains(lower({e}), 'card') THEN 'card:' ELSE 'account:' END || right(list_last({runs}), 4))"
            sig.append(
                f"(p_amount_t NOT IN ('NULL', 'VARCHAR') AND try_cast(p_amount AS DOUBLE) = try_cast(json_extract_string({j}, '$.amount') AS DOUBLE) "
                f"AND nullif(lower({strip('p_counterparty')}), '') IS NOT DISTINCT FROM lower(json_extract_string({j}, '$.counterparty')) AND ({_account('p')}) IS NOT DISTINCT FROM {key})"
            )
    metrics = {
        "json_validity": num("pk <> 'error'"),
        "rejection_accuracy": f"CASE WHEN pk = 'error' THEN 0.0 ELSE {num('(rk = ' + lit('null') + ') = (pk = ' + lit('null') + ')')} END",
        "field_accuracy": acc(f"(({same('counterparty')}) + ({same('type')}) + ({same('account')}))::DOUBLE / 3"),
        "amount_accuracy": acc(num(amount)),
        "type_accuracy": acc(num(kind_same)),
        "account_accuracy": acc(num(account)),
        "counterparty_accuracy": acc(num(who)),
        "ghost_transaction_rate": num("rk = 'null' AND pk = 'object'"),
        "missed_transaction_rate": num("rk <> 'null' AND pk = 'null'"),
        "full_match_accuracy": acc(num(f"{amount} AND {kind_same} AND ({account}) AND ({who})")),
        "few_shot_leakage_rate": num(f"rk = 'null' AND pk = 'object' AND ({' OR '.join(sig)})"),
    }
    cols = ", ".join(f"({e})::DOUBLE AS {n}" for n, e in metrics.items())
    return f"s AS MATERIALIZED ({side}), v AS MATERIALIZED ({fields}), m AS MATERIALIZED (SELECT {keep}, {cols} FROM v)"


_SCORED = f"WITH {_FILTERED}, {_scored('u', 'sample_id, run_id, doc_id, filter')}"


# ---- answers --------------------------------------------------------------------------------------------------------


@register("rsp1_extract_json", f"SELECT sample_id, p1 AS answer FROM ({_ANSWERS})")
def rsp1(spark, d):
    return table(spark, d, "samples").select("sample_id", A.extract_json(A.first_response(F.col("resps"))).alias("answer"))


@register("rsp2_extract_json_nonnull", f"WITH {_FILTERED} SELECT sample_id, p2 AS answer FROM b")
def rsp2(spark, d):
    return table(spark, d, "samples").select("sample_id", A.extract_json_nonnull(A.first_response(F.col("resps"))).alias("answer"))


@register("rsp3_first_response", f"SELECT sample_id, {_RAW} AS answer FROM samples")
def rsp3(spark, d):
    return table(spark, d, "samples").select("sample_id", A.first_response(F.col("resps")).alias("answer"))


@register("rsp4_kinds", f"WITH a AS ({_ANSWERS}) SELECT sample_id, {_kind('target')} AS target_kind, {_kind('p1')} AS answer_kind FROM a")
def rsp4(spark, d):
    s = table(spark, d, "samples")
    return s.select("sample_id", A.parsed(F.col("target"))["kind"].alias("target_kind"), A.parsed(A.extract_json(A.first_response(F.col("resps"))))["kind"].alias("answer_kind"))


@register("rsp5_nullish_fields", f"WITH k AS (SELECT item_id, expected AS p1 FROM gold WHERE {_kind('expected')} = 'object') SELECT item_id, " + ", ".join(f"coalesce({_NULLISH(f)}, false) AS {f}" for f in A.FIELDS) + " FROM k")
def rsp5(spark, d):
    g = table(spark, d, "gold").select("item_id", A.parsed(F.col("expected")).alias("p")).where(F.col("p.kind") == "object")
    return g.select("item_id", *(A.nullish(F.col("p")["v"][f]).alias(f) for f in A.FIELDS))


@register("udf6_grammar", "SELECT sample_id, coalesce(regexp_matches(filtered_resps[1], " + lit(P.GRAMMAR) + "), false) AS grammar_ok FROM samples")
def udf6(spark, d):
    return table(spark, d, "samples").select("sample_id", A.grammar_ok(F.try_element_at("filtered_resps", F.lit(1))).alias("grammar_ok"))


_GOLD_V = f"(SELECT item_id, {_kind('expected')} AS rk, expected FROM gold)"


@register("nrm_gold_keys", f"WITH g AS {_GOLD_V}, v AS (SELECT *, {_side('expected', 'rk', 'r')} FROM g WHERE rk = 'object') SELECT item_id, {_account('r')} AS account_key, CASE WHEN r_type_t = 'VARCHAR' THEN lower({strip('r_type')}) END AS type_key FROM v")
def nrm(spark, d):
    """NRM1 and NRM2 over the gold records."""
    g = table(spark, d, "gold").select("item_id", A.parsed(F.col("expected")).alias("p")).where(F.col("p.kind") == "object")
    return g.select("item_id", A.account_key(F.col("p")["v"]["account"]).alias("account_key"), A.type_key(F.col("p")["v"]["type"]).alias("type_key"))


@register("met_per_sample", f"{_SCORED} SELECT sample_id, filter, {', '.join(f'round({m}, 6) AS {m}' for m in A.METRICS)} FROM m")
def met_per_sample(spark, d):
    """MET1 to MET11, MAT1, MAT2 for each answer and filter."""
    s = A.scored(A.filtered_pairs(table(spark, d, "samples")), keep=("sample_id", "filter"))
    return s.select("sample_id", "filter", *(F.round(m, 6).alias(m) for m in A.METRICS))


_MEANS = ", ".join(f"round(avg({m}), 6) AS {m}" for m in A.METRICS)


@register("agg11_run_metrics", f"{_SCORED} SELECT run_id, filter, count(*)::BIGINT AS n_samples, {_MEANS} FROM m GROUP BY run_id, filter")
def agg11(spark, d):
    return A.run_metrics(table(spark, d, "samples"))


_STORED = ["json_validity", "amount_accuracy", "full_match_accuracy"]


@register("agg12_describe", " UNION ALL ".join(f"SELECT '{m}' AS metric, count({m})::BIGINT AS n, round(avg({m}), 6) AS mean, round(stddev_samp({m}), 6) AS std, min({m}) AS min, round(quantile_cont({m}, 0.25), 6) AS p25, round(quantile_cont({m}, 0.5), 6) AS p50, round(quantile_cont({m}, 0.75), 6) AS p75, max({m}) AS max FROM samples" for m in _STORED))
def agg12(spark, d):
    return A.describe(table(spark, d, "samples"), _STORED)


# ---- runs -----------------------------------------------------------------------------------------------------------


def catalogue(spark, d) -> DataFrame:
    """Runs with their metrics through the stricter filter; runs without samples count 0."""
    m = A.run_metrics(table(spark, d, "samples")).where(F.col("filter") == "extract_json_nonnull").drop("filter")
    r = table(spark, d, "runs").join(m, "run_id", "left")
    return r.select(*table(spark, d, "runs").columns, F.coalesce("n_samples", F.lit(0)).alias("n_samples"), *(F.coalesce(x, F.lit(0.0)).alias(x) for x in A.METRICS))


_CATALOGUE = (
    f"{_SCORED}, means AS MATERIALIZED (SELECT run_id, count(*)::BIGINT AS n_samples, {_MEANS} FROM m WHERE filter = 'extract_json_nonnull' GROUP BY run_id), "
    f"cat AS MATERIALIZED (SELECT r.*, coalesce(n_samples, 0) AS n_samples, {', '.join(f'coalesce(x.{m}, 0.0) AS {m}' for m in A.METRICS)} FROM runs r LEFT JOIN means x ON r.run_id = x.run_id)"
)


@register("fn19_catalogue", f"{_CATALOGUE} SELECT run_id, n_samples, json_validity, full_match_accuracy FROM cat")
def fn19(spark, d):
    return catalogue(spark, d).select("run_id", "n_samples", "json_validity", "full_match_accuracy")


@register("win1_latest_run", "SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY model_id, quant, thinking_budget ORDER BY started_at DESC, run_id DESC) = 1")
def win1(spark, d):
    return R.latest(table(spark, d, "runs"))


@register("win2_preferred_run", f"{_CATALOGUE} SELECT model_id, run_id FROM cat QUALIFY row_number() OVER (PARTITION BY model_id ORDER BY (quant <> 'Q4_K_M'), thinking_budget DESC, full_match_accuracy DESC, run_id) = 1")
def win2(spark, d):
    return R.preferred(catalogue(spark, d)).select("model_id", "run_id")


_IS_NULL = f"coalesce({strip('target')}, '') = 'null'"


@register("win3_interleaved", f"SELECT sample_id FROM (SELECT sample_id, {_IS_NULL} AS k, row_number() OVER (PARTITION BY {_IS_NULL} ORDER BY sample_id) AS turn FROM samples) ORDER BY turn, k LIMIT 8")
def win3(spark, d):
    return R.interleaved(table(spark, d, "samples")).select("sample_id")


@register("win5_last_write", "SELECT run_id, doc_id, sample_id, target FROM samples QUALIFY row_number() OVER (PARTITION BY run_id, doc_id ORDER BY sample_id DESC) = 1")
def win5(spark, d):
    return R.last_write(table(spark, d, "samples")).select("run_id", "doc_id", "sample_id", "target")


@register("fn10_quants", "SELECT run_id, CASE WHEN regexp_matches(p, " + lit(P.QUANT) + ") THEN regexp_extract(p, " + lit(P.QUANT) + ", 1) ELSE '?' END AS quant, replace(model_id, '/', '__') AS slug FROM (SELECT *, replace(model_id, '/', '__') || '-' || quant || '.gguf' AS p FROM runs)")
def fn10(spark, d):
    """FN10 and FN11."""
    r = table(spark, d, "runs")
    path = F.concat(R.slug(F.col("model_id")), F.lit("-"), F.col("quant"), F.lit(".gguf"))
    return r.select("run_id", R.quant_of(path).alias("quant"), R.slug(F.col("model_id")).alias("slug"))


_THINK = "^[\\t\\n\\x0b\\f\\r ]*<think>(.*?)</think>(.*)$"


@register(
    "fn12_thinking_parts",
    f"SELECT sample_id, CASE WHEN has THEN {strip(f'''regexp_extract(raw, '{_THINK}', 1, 's')''')} ELSE '' END AS thinking, CASE WHEN has THEN {strip(f'''regexp_extract(raw, '{_THINK}', 2, 's')''')} ELSE {strip('raw')} END AS answer "
    f"FROM (SELECT sample_id, {_RAW} AS raw, coalesce(regexp_matches({_RAW}, '{_THINK}', 's'), false) AS has FROM samples)",
)
def fn12(spark, d):
    thought, said = R.thinking_parts(A.first_response(F.col("resps")))
    return table(spark, d, "samples").select("sample_id", thought.alias("thinking"), said.alias("answer"))


_BADGES = (
    "CASE WHEN missed_transaction_rate > 0.3 OR ghost_transaction_rate > 0.2 OR few_shot_leakage_rate > 0.05 THEN array_to_string(list_filter([CASE WHEN missed_transaction_rate > 0.3 THEN 'over-rejects' END, "
    "CASE WHEN ghost_transaction_rate > 0.2 THEN 'ghost-prone' END, CASE WHEN few_shot_leakage_rate > 0.05 THEN 'leaks-few-shot' END], lambda x: x IS NOT NULL), ',') WHEN full_match_accuracy > 0.7 THEN 'clean' ELSE 'mid' END"
)


@register("fn13_badges", f"{_CATALOGUE} SELECT run_id, {_BADGES} AS badges FROM cat")
def fn13(spark, d):
    b = R.badges(F.col("missed_transaction_rate"), F.col("ghost_transaction_rate"), F.col("few_shot_leakage_rate"), F.col("full_match_accuracy"))
    return catalogue(spark, d).select("run_id", F.array_join(b, ",").alias("badges"))


def _extremes(best: bool) -> str:
    each = []
    for m, (_, _, up) in A.METRICS.items():
        top, low = ("max", "min") if up else ("min", "max")
        is_best = f"abs({m} - {top}({m}) OVER ()) < 1e-9"
        each.append(f"CASE WHEN {is_best} THEN '{m}' END" if best else f"CASE WHEN NOT ({is_best}) AND abs({m} - {low}({m}) OVER ()) < 1e-9 THEN '{m}' END")
    return f"array_to_string(list_filter([{', '.join(each)}], lambda x: x IS NOT NULL), ',')"


@register("agg13_leaderboard", f"{_CATALOGUE} SELECT run_id, row_number() OVER (ORDER BY full_match_accuracy DESC, model_id, quant, thinking_budget, run_id)::INTEGER AS rank, {_extremes(True)} AS best, {_extremes(False)} AS worst FROM cat")
def agg13(spark, d):
    """AGG13 and SRT2."""
    b = R.leaderboard(catalogue(spark, d))
    return b.select("run_id", "rank", F.array_join("best", ",").alias("best"), F.array_join("worst", ",").alias("worst"))


@register("agg14_run_totals", "SELECT count(*)::BIGINT AS n_runs, count(DISTINCT model_id)::BIGINT AS n_models FROM runs")
def agg14(spark, d):
    return table(spark, d, "runs").agg(F.count("*").alias("n_runs"), F.countDistinct("model_id").alias("n_models"))


@register("agg15_pass_tally", "SELECT run_id, count_if(full_match_accuracy >= 0.999)::BIGINT AS passed, count_if(full_match_accuracy < 0.999)::BIGINT AS failed FROM samples GROUP BY run_id")
def agg15(spark, d):
    v = F.col("full_match_accuracy")
    return table(spark, d, "samples").groupBy("run_id").agg(F.count_if(v >= 0.999).alias("passed"), F.count_if(v < 0.999).alias("failed"))


@register(
    "agg15_failed_variants",
    "SELECT count_if(ok)::BIGINT AS passed, count_if(NOT ok)::BIGINT AS failed, coalesce(string_agg(run_id, ',' ORDER BY run_id) FILTER (NOT ok), '') AS failed_variants "
    "FROM (SELECT run_id, coalesce(best >= 0.5, false) AS ok FROM runs LEFT JOIN (SELECT run_id, avg(full_match_accuracy) AS best FROM samples GROUP BY run_id) USING (run_id))",
)
def agg15_variants(spark, d):
    """How many variants passed and failed, and which failed; one without samples has failed."""
    mean = table(spark, d, "samples").groupBy("run_id").agg(F.avg("full_match_accuracy").alias("mean"))
    return R.tally(table(spark, d, "runs").select("run_id").join(mean, "run_id", "left").select(F.col("run_id").alias("variant"), F.coalesce(F.col("mean") >= 0.5, F.lit(False)).alias("ok")))


@register("fn15_verdicts", "SELECT sample_id, CASE WHEN full_match_accuracy >= 0.999 THEN 'match' ELSE 'miss' END AS verdict FROM samples")
def fn15(spark, d):
    return table(spark, d, "samples").select("sample_id", F.when(F.col("full_match_accuracy") >= 0.999, "match").otherwise("miss").alias("verdict"))


@register("fn18_context_size", "SELECT run_id, least(coalesce(n_ctx, 32768), 32768)::BIGINT AS n FROM runs")
def fn18(spark, d):
    return table(spark, d, "runs").select("run_id", R.context_size(F.col("n_ctx")).cast("long").alias("n"))


_PAIR = ["target", "full_match_accuracy"]


@register("join2_two_runs", "SELECT a.doc_id, a.target AS target_a, a.full_match_accuracy AS full_match_accuracy_a, b.target AS target_b, b.full_match_accuracy AS full_match_accuracy_b FROM samples a JOIN samples b ON a.doc_id = b.doc_id WHERE a.run_id = 'run01' AND b.run_id = 'run02'")
def join2(spark, d):
    s = table(spark, d, "samples")
    return R.compare(s.where("run_id = 'run01'"), s.where("run_id = 'run02'"), "doc_id", _PAIR, ("_a", "_b"))


@register("join4_runs_with_samples", "SELECT run_id FROM runs WHERE run_id IN (SELECT run_id FROM samples)")
def join4(spark, d):
    return table(spark, d, "runs").join(table(spark, d, "samples").select("run_id").distinct(), "run_id", "left_semi").select("run_id")


@register("join5_chosen_documents", f"SELECT sample_id, doc_id FROM samples WHERE doc_id IN (SELECT doc_id FROM (SELECT doc_id, {_IS_NULL} AS k, row_number() OVER (PARTITION BY {_IS_NULL} ORDER BY sample_id) AS turn, sample_id FROM samples) ORDER BY turn, k LIMIT 8)")
def join5(spark, d):
    """JOIN5 and FLT8: all samples of the documents the viewer chose."""
    s = table(spark, d, "samples")
    return s.join(F.broadcast(R.interleaved(s).select("doc_id").distinct()), "doc_id", "left_semi").select("sample_id", "doc_id")


@register(
    "join7_sweep",
    "WITH m AS (SELECT DISTINCT model_id, contains(model_id, 'think') AS thinking FROM runs), q AS (SELECT DISTINCT quant FROM runs), w AS (SELECT DISTINCT model_id, quant FROM runs), b AS (SELECT DISTINCT thinking_budget FROM runs WHERE thinking_budget > 0), "
    "p AS (SELECT m.model_id, q.quant, m.thinking FROM m, q WHERE (m.model_id, q.quant) IN (SELECT (model_id, quant) FROM w)) SELECT model_id, quant, thinking_budget FROM p, b WHERE thinking UNION ALL SELECT model_id, quant, 0 FROM p WHERE NOT thinking",
)
def join7(spark, d):
    r = table(spark, d, "runs")
    models = r.select("model_id", F.contains("model_id", F.lit("think")).alias("thinking")).distinct()
    return R.sweep(models, r.select("quant").distinct(), r.where("thinking_budget > 0").select("thinking_budget").distinct(), r.select("model_id", "quant").distinct()).select("model_id", "quant", "thinking_budget")


@register(
    "join9_viewer",
    f"WITH s AS (SELECT *, {_IS_NULL} AS k FROM samples), c AS (SELECT DISTINCT doc_id FROM (SELECT doc_id FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY sample_id) AS turn FROM s) ORDER BY turn, k LIMIT 8)), "
    "l AS (SELECT run_id, doc_id, arg_max(full_match_accuracy, sample_id) AS v FROM samples GROUP BY run_id, doc_id) "
    "SELECT c.doc_id, r.run_id, CASE WHEN l.run_id IS NULL THEN '(no sample)' WHEN v >= 0.999 THEN 'match' ELSE 'miss' END AS verdict FROM c CROSS JOIN runs r LEFT JOIN l ON l.doc_id = c.doc_id AND l.run_id = r.run_id",
)
def join9(spark, d):
    s = table(spark, d, "samples")
    return R.viewer(R.interleaved(s), table(spark, d, "runs"), s).select("doc_id", "run_id", "verdict")


_UP = ", ".join(f"('{m}', {str(up).lower()})" for m, (_, _, up) in A.METRICS.items())


@register("join10_metric_directions", f"WITH d(metric, higher_is_better) AS (VALUES {_UP}), s AS (SELECT 'json_validity' AS metric, avg(json_validity) AS v FROM samples UNION ALL SELECT 'amount_accuracy', avg(amount_accuracy) FROM samples UNION ALL SELECT 'full_match_accuracy', avg(full_match_accuracy) FROM samples) SELECT s.metric, round(v, 6) AS mean, higher_is_better FROM s JOIN d ON s.metric = d.metric")
def join10(spark, d):
    ways = spark.createDataFrame([(m, up) for m, (_, _, up) in A.METRICS.items()], "metric string, higher_is_better boolean")
    return A.describe(table(spark, d, "samples"), _STORED).select("metric", "mean").join(F.broadcast(ways), "metric")


@register("join8_leaks", f"{_SCORED} SELECT sample_id FROM m WHERE filter = 'extract_json' AND few_shot_leakage_rate = 1")
def join8(spark, d):
    s = A.scored(A.filtered_pairs(table(spark, d, "samples")).where("filter = 'extract_json'"), keep=("sample_id",))
    return s.where("few_shot_leakage_rate = 1").select("sample_id")


_SHOWN = [a for _, _, a in A.EXEMPLARS]


@register("join8_shown_leaks", f"SELECT sample_id FROM (SELECT sample_id, target, [{', '.join(lit(a) for a in _SHOWN)}][doc_id % {len(_SHOWN)} + 1] AS said FROM samples) WHERE {_kind('target')} = 'null' AND {_kind('said')} = 'object'")
def join8_shown(spark, d):
    """The leak metric where every answer repeats what an exemplar of the prompt shows."""
    said = F.element_at(F.array(*map(F.lit, _SHOWN)), (F.col("doc_id") % len(_SHOWN) + 1).cast("int"))
    pairs = table(spark, d, "samples").select("sample_id", "target", said.alias("prediction"))
    return A.scored(pairs, keep=("sample_id",)).where("few_shot_leakage_rate = 1").select("sample_id")


@register("src12_first_response_thinks", f"SELECT run_id, coalesce(contains(arg_min_null({_RAW}, sample_id), '<think>'), false) AS thinking FROM samples GROUP BY run_id")
def src12(spark, d):
    first = F.min_by(F.coalesce(A.first_response(F.col("resps")), F.lit("")), "sample_id")
    return table(spark, d, "samples").groupBy("run_id").agg(F.contains(first, F.lit("<think>")).alias("thinking"))


@register("lim1_samples_per_run", "SELECT run_id, sample_id FROM samples QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY sample_id) <= 10")
def lim1(spark, d):
    n = F.row_number().over(Window.partitionBy("run_id").orderBy("sample_id"))
    return table(spark, d, "samples").select("run_id", "sample_id", n.alias("n")).where("n <= 10").select("run_id", "sample_id")


@register("prj6_nested_fields", f"SELECT sample_id, doc.sms AS sms, doc.sender AS sender, {_RAW} AS response FROM samples")
def prj6(spark, d):
    return table(spark, d, "samples").select("sample_id", F.col("doc.sms").alias("sms"), F.col("doc.sender").alias("sender"), A.first_response(F.col("resps")).alias("response"))


@register("fn20_prompts", "SELECT item_id, " + lit(M.prompt_prefix()) + " || chr(10) || 'Sender: ' || coalesce(sender, '') || chr(10) || 'Message: ' || sms || chr(10) || 'Answer:' AS prompt FROM gold WHERE sms IS NOT NULL")
def fn20(spark, d):
    return table(spark, d, "gold").where("sms IS NOT NULL").select("item_id", M.prompt(F.col("sender"), F.col("sms")).alias("prompt"))


@register("fn21_targets", "SELECT item_id, expected AS target FROM gold")
def fn21(spark, d):
    return table(spark, d, "gold").select("item_id", F.col("expected").alias("target"))


_RULE = M.RulePredictor
_FIRST = lambda p: f"length(regexp_extract(sms, {lit('(?is)^(.*?)' + p.removeprefix('(?i)'))}, 1))"
_HAS = lambda p: f"regexp_matches(sms, {lit(p)})"
_PREDICTED = (
    f"CASE WHEN {_HAS(_RULE.AMOUNT)} AND {_HAS(_RULE.ACCOUNT)} AND ({_HAS(_RULE.OUT)} OR {_HAS(_RULE.IN)}) THEN json_object("
    f"'amount', coalesce(try_cast(replace(regexp_extract(sms, {lit(_RULE.AMOUNT)}, 1), ',', '') AS DOUBLE), 0.0), 'counterparty', CASE WHEN {_HAS(_RULE.WHO)} THEN {strip(f'regexp_extract(sms, {lit(_RULE.WHO)}, 1)')} END, "
    f"'type', CASE WHEN {_HAS(_RULE.IN)} AND (NOT {_HAS(_RULE.OUT)} OR {_FIRST(_RULE.IN)} < {_FIRST(_RULE.OUT)}) THEN 'credit' ELSE 'debit' END, 'account', regexp_extract(sms, {lit(_RULE.ACCOUNT)}, 1))::VARCHAR ELSE 'null' END"
)


@register("udf4_rule_predictor", f"WITH u AS MATERIALIZED (SELECT item_id AS doc_id, expected AS target, {_PREDICTED} AS prediction FROM gold WHERE sms IS NOT NULL), {_scored('u', 'doc_id')} SELECT * FROM m")
def udf4(spark, d):
    """UDF4: a predictor behind the Arrow hook, scored as any model; it needs no weights."""
    g = table(spark, d, "gold").where("sms IS NOT NULL")
    prompts = g.select(F.col("item_id").alias("doc_id"), M.prompt(F.col("sender"), F.col("sms")).alias("prompt"))
    answers = M.predicted(prompts, M.RulePredictor)
    pairs = g.select(F.col("item_id").alias("doc_id"), F.col("expected").alias("target")).join(answers, "doc_id").withColumn("prediction", A.extract_json(F.col("response")))
    return A.scored(pairs, keep=("doc_id",))


@register("src9_newest_backup", "SELECT run_id AS path FROM runs ORDER BY started_at DESC NULLS LAST, run_id DESC LIMIT 1")
def src9(spark, d):
    """SRC9: the file changed last, of runs listed as files."""
    return files.newest(table(spark, d, "runs").select(F.col("run_id").alias("path"), F.col("started_at").alias("modified_at")))


@register("src10_smallest_document", "SELECT doc_id::VARCHAR AS path FROM documents WHERE n_chars IS NOT NULL ORDER BY n_chars, doc_id::VARCHAR LIMIT 1")
def src10(spark, d):
    """SRC10: the smallest file, of documents listed as files."""
    return files.smallest(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("n_chars").alias("bytes")).where("bytes IS NOT NULL"))
