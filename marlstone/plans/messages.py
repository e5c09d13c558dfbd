"""Queries over messages: ingest, quality, funnel, extraction, gold set."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import patterns as P
from marlstone.functions import text as T
from marlstone.operators import extract as X
from marlstone.operators import funnel as N
from marlstone.operators import goldset as G
from marlstone.operators import ingest as I
from marlstone.operators import quality as Q
from marlstone.plans.fixtures import BANK_SQL, bank_messages
from marlstone.plans.sqltext import has, lit, re2, strip
from marlstone.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# ---- shared SQL -----------------------------------------------------------------------------------------------------

_NOT_OWN = "sender IS DISTINCT FROM 'me'"
_SENDER = strip("CASE WHEN sender IS NULL OR sender = '' THEN 'nan' ELSE sender END")
CATEGORY = "CASE " + " ".join(f"WHEN regexp_matches({_SENDER}, {lit(p)}) THEN {lit(n)}" for n, p in P.SENDER_CATEGORIES) + f" ELSE {lit(P.SENDER_OTHERS)} END"


def _flags(old: bool = False) -> str:
    s1, s2, s3 = has("text", P.AMOUNT), has("text", P.ACCOUNT), has("text", P.VERB_OLD if old else P.VERB)
    s4, s5 = f"NOT {has('text', P.OTP)}", f"NOT {has('text', P.COLLECT)}"
    each = [s1, f"{s1} AND {s2}", f"{s1} AND {s2} AND {s3}", f"{s1} AND {s2} AND {s3} AND {s4}", f"{s1} AND {s2} AND {s3} AND {s4} AND {s5}"]
    return ", ".join(f"({c}) AS {n}" for c, n in zip(each, N.STAGES))


def _commercial(source: str = "all_sms") -> str:
    return f"(SELECT *, {CATEGORY} AS sender_category FROM {source} AS src WHERE {_NOT_OWN} AND {CATEGORY} <> 'Mobile Number')"


def _funnel(source: str = "all_sms", old: bool = False) -> str:
    return f"(SELECT *, {_flags(old)} FROM {_commercial(source)} AS com)"


def _counts(source: str, old: bool = False) -> str:
    parts = []
    for k, s in enumerate(N.STAGES):
        before = f"count_if({N.STAGES[k - 1]})" if k else "count(*)"
        parts.append(f"SELECT '{s}' AS stage, count_if({s})::BIGINT AS retained, ({before} - count_if({s}))::BIGINT AS dropped, CASE WHEN count(*) > 0 THEN round(100.0::DOUBLE * count_if({s}) / count(*), 2) END AS percent FROM f")
    return f"WITH f AS {_funnel(source, old)} " + " UNION ALL ".join(parts)


# ---- ingest ---------------------------------------------------------------------------------------------------------

_TIME = "TIMESTAMP '1970-01-01' + to_microseconds(978307200000000 + (date + 500) // 1000)"


@register(
    "join1_message_handle",
    "SELECT m.rowid AS id, m.date, CASE WHEN m.is_from_me = 1 THEN 'me' ELSE h.id END AS sender, (m.is_from_me = 1) AS is_from_me, coalesce(m.service, '') AS service "
    "FROM message m LEFT JOIN handle h ON m.handle_id = h.rowid WHERE m.date > 0",
)
def join1(spark, d):
    """Left join of messages to handles, own messages named."""
    m = table(spark, d, "message").where("date > 0")
    h = table(spark, d, "handle").select(F.col("rowid").alias("handle_id"), F.col("id").alias("handle"))
    j = m.join(I.bounded_broadcast(h), "handle_id", "left")
    return j.select(F.col("rowid").alias("id"), "date", F.when(F.col("is_from_me") == 1, "me").otherwise(F.col("handle")).alias("sender"), (F.col("is_from_me") == 1).alias("is_from_me"), F.coalesce("service", F.lit("")).alias("service"))


@register("fn7_apple_time", f"SELECT rowid AS id, {_TIME} AS sent_at FROM message WHERE date > 0")
def fn7(spark, d):
    return table(spark, d, "message").where("date > 0").select(F.col("rowid").alias("id"), I.apple_time(F.col("date")).alias("sent_at"))


_REST = "regexp_extract(hex(attributedbody), '^(?:[0-9A-F]{2})*?4E53537472696E67((?:[0-9A-F]{2})*)$', 1)"
_AFTER = f"regexp_extract({_REST}, '^(?:[0-9A-F]{{2}})*?012B((?:[0-9A-F]{{2}})*)$', 1)"
_BYTE = lambda k: f"try_cast('0x' || substr(h, {2 * k + 1}, 2) AS BIGINT)"
_SIZE = f"CASE WHEN {_BYTE(0)} < 128 THEN {_BYTE(0)} WHEN {_BYTE(0)} = 129 THEN {_BYTE(1)} + 256 * {_BYTE(2)} WHEN {_BYTE(0)} = 130 THEN {_BYTE(1)} + 256 * {_BYTE(2)} + 65536 * {_BYTE(3)} + 16777216 * {_BYTE(4)} END"
_SKIP = f"CASE {_BYTE(0)} WHEN 129 THEN 6 WHEN 130 THEN 10 ELSE 2 END"
_BODY = f"(SELECT rowid, date, text, handle_id, is_from_me, service, attributedbody, CASE WHEN length(h) > 0 AND ({_SIZE}) IS NOT NULL THEN substr(h, {_SKIP} + 1, 2 * ({_SIZE})) END AS body FROM (SELECT *, {_AFTER} AS h FROM message))"


@register("fn6_attributed_bytes", f"SELECT rowid AS id, body FROM {_BODY} AS b WHERE body IS NOT NULL")
def fn6_bytes(spark, d):
    m = table(spark, d, "message").select(F.col("rowid").alias("id"), F.hex(I.attributed_bytes(F.col("attributedbody"))).alias("body"))
    return m.where("body IS NOT NULL")


# A sequence that the end cuts off becomes one replacement character.
_CLEAN = "regexp_replace(body, '^((?:[0-9A-F]{2})*?)(?:C[2-9A-F]|D[0-9A-F]|E[0-9A-F](?:[89AB][0-9A-F])?|F[0-4](?:[89AB][0-9A-F]){0,2})$', '\\1')"
_DECODED = f"decode(unhex({_CLEAN})) || CASE WHEN {_CLEAN} <> body THEN chr(65533) ELSE '' END"


@register("fn6_attributed_body", f"SELECT rowid AS id, {_DECODED} AS text FROM {_BODY} AS b WHERE attributedbody IS NOT NULL")
def fn6(spark, d):
    return table(spark, d, "message").where("attributedbody IS NOT NULL").select(F.col("rowid").alias("id"), I.attributed_body(F.col("attributedbody")).alias("text"))


@register(
    "flt5_exported",
    f"SELECT * FROM (SELECT b.rowid AS id, {_TIME} AS date, coalesce(CASE WHEN is_from_me = 1 THEN 'me' ELSE h.id END, '') AS sender, CASE WHEN {strip('text')} <> '' THEN text WHEN {strip('decoded')} <> '' THEN decoded END AS text, "
    f"CAST(is_from_me AS BOOLEAN) AS is_from_me, coalesce(service, '') AS service FROM (SELECT *, {_DECODED} AS decoded FROM {_BODY} AS x) AS b LEFT JOIN (SELECT rowid AS handle, id FROM handle) AS h ON b.handle_id = h.handle WHERE date > 0) WHERE text IS NOT NULL",
)
def flt5(spark, d):
    return I.exported(table(spark, d, "message"), table(spark, d, "handle"))


@register(
    "agg10_provenance",
    "WITH x AS (SELECT coalesce(" + strip("text") + f", '') <> '' AS plain, body IS NOT NULL AND NOT regexp_matches(body, '^(?:09|0A|0B|0C|0D|20|C2A0)*$') AS full_blob FROM {_BODY} AS b WHERE date > 0) "
    "SELECT count(*)::BIGINT AS total, count_if(plain)::BIGINT AS from_text, count_if(NOT plain AND full_blob)::BIGINT AS from_blob, count_if(NOT plain AND NOT full_blob)::BIGINT AS no_content FROM x",
)
def agg10(spark, d):
    return I.provenance(table(spark, d, "message"))


@register("src2_message_databases", "SELECT fileid, relativepath, substr(fileid, 1, 2) || '/' || fileid AS stored_at FROM backup_files WHERE relativepath ILIKE '%sms.db'")
def src2(spark, d):
    return I.message_databases(table(spark, d, "backup_files"))


@register("srt1_by_date", "SELECT rowid AS id, date FROM message WHERE date > 0 ORDER BY date")
def srt1(spark, d):
    return table(spark, d, "message").where("date > 0").select(F.col("rowid").alias("id"), "date").orderBy("date")


@register("prj2_null_and_boolean_casts", "SELECT rowid AS id, coalesce(text, '') AS text, coalesce(service, '') AS service, CAST(is_from_me AS BOOLEAN) AS is_from_me FROM message")
def prj2(spark, d):
    return table(spark, d, "message").select(F.col("rowid").alias("id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("service", F.lit("")).alias("service"), F.col("is_from_me").cast("boolean").alias("is_from_me"))


@register("prj5_export_fields", "SELECT id, date, sender, text, is_from_me, service FROM all_sms")
def prj5(spark, d):
    return table(spark, d, "all_sms").select("id", "date", "sender", "text", "is_from_me", "service")


# ---- quality --------------------------------------------------------------------------------------------------------


@register(
    "agg4_id_profile",
    "SELECT count(*)::BIGINT AS n_rows, min(id) AS min_id, max(id) AS max_id, count(DISTINCT id)::BIGINT AS distinct_ids, "
    "(min(id) = 1 AND max(id) = count(*) AND count(DISTINCT id) = count(*)) AS exact_sequence, (max(id) - min(id) + 1 = count(DISTINCT id)) AS contiguous FROM all_sms",
)
def agg4(spark, d):
    return Q.id_profile(table(spark, d, "all_sms"))


_MISSING = "(SELECT unnest(range((SELECT min(id) FROM all_sms), (SELECT max(id) FROM all_sms) + 1)) AS id EXCEPT SELECT id FROM all_sms)"


@register("join6_missing_ids", f"SELECT id FROM {_MISSING}")
def join6(spark, d):
    return Q.missing_ids(table(spark, d, "all_sms"))


@register("set2_missing_ids_summary", f"SELECT (SELECT count(*) FROM {_MISSING})::BIGINT AS n_missing, coalesce((SELECT string_agg(id::VARCHAR, ',' ORDER BY id) FROM (SELECT id FROM {_MISSING} ORDER BY id LIMIT 20)), '') AS first_missing")
def set2(spark, d):
    return Q.missing_summary(table(spark, d, "all_sms")).select(F.col("n_missing").cast("long").alias("n_missing"), "first_missing")


@register("agg6_duplicate_ids", "SELECT handle_id AS id, count(*)::BIGINT AS n FROM message GROUP BY handle_id HAVING count(*) > 1 ORDER BY n DESC, id NULLS FIRST LIMIT 20")
def agg6(spark, d):
    return Q.duplicate_ids(table(spark, d, "message"), id_col="handle_id")


@register("agg7_sender_totals", f"SELECT count(*)::BIGINT AS n_rows, count(DISTINCT sender)::BIGINT AS senders FROM all_sms WHERE {_NOT_OWN}")
def agg7(spark, d):
    return Q.sender_totals(table(spark, d, "all_sms"))


@register("agg8_category_histogram", f"SELECT {CATEGORY} AS sender_category, count(*)::BIGINT AS n FROM all_sms WHERE {_NOT_OWN} GROUP BY 1")
def agg8(spark, d):
    return Q.category_histogram(table(spark, d, "all_sms"))


@register("agg9_other_senders", f"SELECT DISTINCT sender FROM all_sms WHERE {_NOT_OWN} AND {CATEGORY} = 'Others' ORDER BY sender LIMIT 20")
def agg9(spark, d):
    return Q.other_senders(table(spark, d, "all_sms"))


@register("top1_senders", f"SELECT sender, count(*)::BIGINT AS n FROM all_sms WHERE {_NOT_OWN} AND sender IS NOT NULL GROUP BY sender ORDER BY n DESC, sender LIMIT 50")
def top1(spark, d):
    return Q.top_senders(table(spark, d, "all_sms"))


# ---- funnel ---------------------------------------------------------------------------------------------------------


@register("flt1_not_own", f"SELECT id, sender FROM all_sms WHERE {_NOT_OWN}")
def flt1(spark, d):
    return table(spark, d, "all_sms").where(N.not_own(F.col("sender"))).select("id", "sender")


@register("flt2_incoming", "SELECT id, text FROM all_sms WHERE NOT is_from_me AND text <> ''")
def flt2(spark, d):
    return N.incoming(table(spark, d, "all_sms")).select("id", "text")


@register("flt4_commercial", f"SELECT id, sender_category FROM {_commercial()} AS c")
def flt4(spark, d):
    return N.commercial(table(spark, d, "all_sms")).select("id", "sender_category")


@register("prj3_sanitised", "SELECT id, " + ", ".join(f"regexp_replace({c}, '[^\\x09\\x0A\\x0D\\x20-\\x{{D7FF}}\\x{{E000}}-\\x{{FFFD}}\\x{{10000}}-\\x{{10FFFF}}]', '', 'g') AS {c}" for c in ("date", "sender", "text")) + " FROM all_sms")
def prj3(spark, d):
    return T.sanitised(table(spark, d, "all_sms").select("id", "date", "sender", "text"))


@register("prj4_sender_category", f"SELECT id, {CATEGORY} AS sender_category FROM all_sms")
def prj4(spark, d):
    return table(spark, d, "all_sms").select("id", N.sender_category(F.col("sender")).alias("sender_category"))


@register("fun_flags", f"SELECT id, {', '.join(N.STAGES)} FROM {_funnel()} AS f")
def fun_flags(spark, d):
    return N.funnel(table(spark, d, "all_sms")).select("id", *N.STAGES)


@register("fun_flags_old", f"SELECT id, {', '.join(N.STAGES)} FROM {_funnel(old=True)} AS f")
def fun_flags_old(spark, d):
    return N.funnel(table(spark, d, "all_sms"), old=True).select("id", *N.STAGES)


@register("fun_counts", _counts("all_sms"))
def fun_counts(spark, d):
    return N.stage_counts(N.funnel(table(spark, d, "all_sms")))


@register("fun_counts_old", _counts("all_sms", old=True))
def fun_counts_old(spark, d):
    return N.stage_counts(N.funnel(table(spark, d, "all_sms"), old=True))


@register("fun_counts_bank", _counts(BANK_SQL))
def fun_counts_bank(spark, d):
    return N.stage_counts(N.funnel(bank_messages(spark, d)))


@register("set3_split_counts", f"WITH f AS {_funnel()} " + " UNION ALL ".join(f"SELECT '{s}' AS stage, CASE WHEN {s} THEN 'likely_transactions' ELSE 'non_transactions' END AS split, count(*)::BIGINT AS n FROM f GROUP BY 2" for s in N.STAGES))
def set3(spark, d):
    """Both sides of each stage; SNK3 writes what this counts."""
    return N.stage_splits(N.funnel(table(spark, d, "all_sms"))).groupBy("stage", "split").agg(F.count("*").alias("n"))


_FIN = " OR ".join(has("text", p) for p in P.FINANCIAL)


@register("fin1_financial", f"SELECT id, ({_FIN}) AS financial FROM all_sms WHERE NOT is_from_me AND text <> ''")
def fin1(spark, d):
    return N.incoming(table(spark, d, "all_sms")).select("id", N.financial(F.col("text")).alias("financial"))


# ---- extraction -----------------------------------------------------------------------------------------------------


def sql_date(x: str) -> str:
    """The date shapes, as SQL over one text."""
    month = "CASE lower({}) " + " ".join(f"WHEN '{m}' THEN '{k + 1:02d}'" for k, m in enumerate(P.MONTHS)) + " END"
    raw = f"regexp_replace({strip(x)}, '\\.+$', '')"
    def g(p: str, k: int) -> str:
        return f"regexp_extract({raw}, '{p}', {k})"

    def day(p: str) -> str:
        return f"lpad({g(p, 1)}, 2, '0')"

    iso, slash, named, dashed, joined, short = (p.replace(r"\d", r"\p{Nd}") for p in P.DATE_SHAPES.values())
    year = f"CASE WHEN length({g(dashed, 3)}) = 4 THEN {g(dashed, 3)} ELSE '20' || {g(dashed, 3)} END"
    hit = lambda p: f"regexp_matches({raw}, '{p}')"
    return (
        f"coalesce(CASE WHEN {hit(iso)} THEN {g(iso, 3)} || '-' || {g(iso, 2)} || '-' || {g(iso, 1)} WHEN {hit(slash)} THEN {day(slash)} || '-' || {g(slash, 2)} || '-20' || {g(slash, 3)} "
        f"WHEN {hit(named)} THEN {day(named)} || '-' || {month.format(g(named, 2))} || '-' || {g(named, 3)} WHEN {hit(dashed)} THEN {day(dashed)} || '-' || {month.format(g(dashed, 2))} || '-' || {year} "
        f"WHEN {hit(joined)} THEN {day(joined)} || '-' || {month.format(g(joined, 2))} || '-20' || {g(joined, 3)} WHEN {hit(short)} THEN {g(short, 1)} || '-' || {g(short, 2)} || '-20' || {g(short, 3)} END, {raw})"
    )


_FIELDS = "amount counterparty date type account".split()


def _extract_sql(source: str = BANK_SQL) -> str:
    rows = []
    for k, (name, pattern, kind, (a, acc, who, when)) in enumerate(P.EXTRACTORS):
        p = lit(re2(pattern))
        g = lambda n, p=p: f"regexp_extract(text, {p}, {n}, 'is')"
        counterparty = strip(g(who)) if who else "NULL"
        if name == "hdfc_credit_alert":
            counterparty = f"regexp_replace(regexp_replace({counterparty}, '\\)+$', ''), '[\\t\\n ]*\\(UPI.*', '', 'is')"
        elif name == "hdfc_neft_deposit":
            counterparty = f"CASE WHEN contains({g(who)}, '-') THEN {strip(f'split_part({g(who)}, chr(45), 2)')} END"
        elif name == "icici_debited":
            counterparty = f"regexp_replace({counterparty}, '\\.+$', '')"
        rows.append(
            f"SELECT id, {k} AS k, '{name}' AS extractor, try_cast(replace({g(a)}, ',', '') AS DOUBLE) AS amount, {counterparty} AS counterparty, "
            f"{sql_date(g(when))} AS date, '{kind}' AS type, {strip(g(acc))} AS account FROM sms WHERE regexp_matches(text, {p}, 'is')"
        )
    return f"WITH sms AS {source}, hits AS ({' UNION ALL '.join(rows)}) SELECT id, extractor, amount, counterparty, date, type, account FROM hits QUALIFY row_number() OVER (PARTITION BY id ORDER BY k) = 1"


@register("ext_first_match", _extract_sql())
def ext_first_match(spark, d):
    """EXT1 to EXT13 and FN1: the first extractor that reads each message."""
    m = bank_messages(spark, d)
    named = m.select("id", "text", X.which_extractor(F.col("text")).alias("extractor")).where("extractor IS NOT NULL")
    return named.select("id", "extractor", X.record_of(F.col("text"), F.col("extractor")).alias("x")).select("id", "extractor", "x.*")


@register("ext_all_sms", f"SELECT id, {', '.join(_FIELDS)} FROM ({_extract_sql('(SELECT id, text FROM all_sms)')})")
def ext_all_sms(spark, d):
    m = table(spark, d, "all_sms")
    return m.select("id", X.transaction(F.col("text")).alias("x")).where("x IS NOT NULL").select("id", "x.*")


@register("fn2_amount", "SELECT id, place::INTEGER AS place, try_cast(replace(a, ',', '') AS DOUBLE) AS amount FROM (SELECT id, unnest(m) AS a, generate_subscripts(m, 1) - 1 AS place FROM (SELECT id, regexp_extract_all(text, '[0-9][0-9,]*(?:\\.[0-9]+)?') AS m FROM all_sms))")
def fn2(spark, d):
    """Every number of every text."""
    found = F.regexp_extract_all("text", F.lit(r"([0-9][0-9,]*(?:\.[0-9]+)?)"), F.lit(1))
    return table(spark, d, "all_sms").select("id", F.posexplode(found).alias("place", "a")).select("id", "place", X.amount(F.col("a")).alias("amount"))


@register("fn3_date", f"SELECT id, {sql_date('date')} AS day FROM all_sms WHERE date IS NOT NULL")
def fn3(spark, d):
    return table(spark, d, "all_sms").where("date IS NOT NULL").select("id", X.date(F.col("date")).alias("day"))


def _cases(rules: list[tuple[str, str]], dotall: bool) -> str:
    return "CASE " + " ".join(f"WHEN {has('text', p, dotall)} THEN '{n}'" for n, p in rules) + " ELSE 'other' END"


@register("fn4_transaction_category", f"SELECT id, {_cases(P.TRANSACTION_CATEGORIES, True)} AS cat FROM {BANK_SQL} AS s WHERE text IS NOT NULL")
def fn4(spark, d):
    return bank_messages(spark, d).where("text IS NOT NULL").select("id", X.transaction_category(F.col("text")).alias("cat"))


@register("fn4_category_all_sms", f"SELECT id, {_cases(P.TRANSACTION_CATEGORIES, True)} AS cat, {has('text', P.FALSE_POSITIVE)} AS false_positive FROM all_sms WHERE text IS NOT NULL")
def fn4_all(spark, d):
    """FN4 and FLT6 over the exported messages."""
    t = F.col("text")
    return table(spark, d, "all_sms").where("text IS NOT NULL").select("id", X.transaction_category(t).alias("cat"), X.false_positive(t).alias("false_positive"))


@register("fn5_other_category", f"SELECT id, {_cases(P.OTHER_CATEGORIES, False)} AS cat FROM all_sms WHERE text IS NOT NULL")
def fn5(spark, d):
    return table(spark, d, "all_sms").where("text IS NOT NULL").select("id", X.other_category(F.col("text")).alias("cat"))


@register("flt6_false_positives", f"SELECT id FROM {BANK_SQL} AS s WHERE {has('text', P.FALSE_POSITIVE)}")
def flt6(spark, d):
    return bank_messages(spark, d).where(X.false_positive(F.col("text"))).select("id")


@register("fn8_iso_time", "SELECT id, CASE WHEN regexp_matches(date, '^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(?:\\.[0-9]{1,6})?$') THEN try_cast(date AS TIMESTAMP) END AS at FROM all_sms")
def fn8(spark, d):
    return table(spark, d, "all_sms").select("id", I.iso_time(F.col("date")).alias("at"))


@register("fn9_epoch_seconds", "SELECT id, CASE WHEN regexp_matches(date, '^[0-9]{1,12}(?:\\.[0-9]+)?$') AND date::DOUBLE < 253402300800 THEN make_timestamp((date::DOUBLE * 1000000)::BIGINT) END AS at FROM all_sms")
def fn9(spark, d):
    return table(spark, d, "all_sms").select("id", I.epoch_seconds(F.col("date")).alias("at"))


_ELL = "chr(8230)"


@register(
    "fn14_truncations",
    f"SELECT id, substr(text, 1, 80) AS prefix, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || {_ELL} ELSE text END AS preview, replace(text, chr(10), ' ') AS line FROM all_sms",
)
def fn14(spark, d):
    t = F.col("text")
    return table(spark, d, "all_sms").select("id", T.prefix(t).alias("prefix"), T.truncate(t, 100).alias("preview"), T.one_line(t).alias("line"))


@register("fn16_html_escape", "SELECT id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS html FROM all_sms")
def fn16(spark, d):
    return table(spark, d, "all_sms").select("id", T.html_escape(F.col("text")).alias("html"))


@register(
    "fn17_coercions",
    f"SELECT DISTINCT service, coalesce(lower({strip('service')}) IN ('1', 'true', 'yes', 'on'), false) AS flag, CASE WHEN {strip('service')} <> '' AND lower({strip('service')}) NOT IN ('none', 'null') THEN {strip('service')} END AS maybe FROM all_sms",
)
def fn17(spark, d):
    s = F.col("service")
    return table(spark, d, "all_sms").select("service", T.to_bool(s).alias("flag"), T.maybe_string(s).alias("maybe")).distinct()


# ---- gold set -------------------------------------------------------------------------------------------------------

_YEAR = "CASE WHEN regexp_matches(date, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN try_cast(substr(date, 1, 4) AS INTEGER) END"


@register("flt7_years", f"SELECT id, {_YEAR} AS year FROM all_sms WHERE {_YEAR} IN (2025, 2026)")
def flt7(spark, d):
    return table(spark, d, "all_sms").select("id", G.year_of(F.col("date")).alias("year")).where("year IN (2025, 2026)")


@register("join3_not_in_gold", "SELECT id FROM all_sms WHERE text IS NOT NULL AND substr(text, 1, 80) NOT IN (SELECT substr(sms, 1, 80) FROM gold WHERE sms IS NOT NULL)")
def join3(spark, d):
    return G.not_in_gold(table(spark, d, "all_sms").where("text IS NOT NULL"), table(spark, d, "gold")).select("id")


_TARGETS = " UNION ALL ".join(f"SELECT {y} AS year, '{c}' AS cat, {n} AS n" for y, cs in P.OTHER_TARGETS.items() for c, n in cs.items())


@register(
    "win4_stratified",
    f"WITH f AS (SELECT *, {_YEAR} AS year FROM {_funnel()} AS x WHERE text IS NOT NULL), c AS (SELECT id, text, year, {_cases(P.OTHER_CATEGORIES, False)} AS cat FROM f WHERE NOT s5_not_collect AND substr(text, 1, 80) NOT IN (SELECT substr(sms, 1, 80) FROM gold WHERE sms IS NOT NULL)), "
    f"t AS ({_TARGETS}) SELECT id, c.year, c.cat FROM c JOIN t ON c.year = t.year AND c.cat = t.cat QUALIFY row_number() OVER (PARTITION BY c.year, c.cat ORDER BY md5('42' || text || id::VARCHAR)) <= any_value(n) OVER (PARTITION BY c.year, c.cat)",
)
def win4(spark, d):
    pool = G.not_in_gold(G.candidates(table(spark, d, "all_sms")).where("NOT is_txn"), table(spark, d, "gold"))
    return G.stratified(pool, G.targets(spark, P.OTHER_TARGETS)).select("id", "year", "cat")


def _drawn(txn: bool) -> str:
    """The draw of new gold rows of one kind, as SQL over the bank messages."""
    cat = _cases(P.TRANSACTION_CATEGORIES, True) if txn else _cases(P.OTHER_CATEGORIES, False)
    kept = f"s5_not_collect AND NOT {has('text', P.FALSE_POSITIVE)}" if txn else "NOT s5_not_collect"
    wanted = " UNION ALL ".join(f"SELECT {y} AS year, '{c}' AS cat, {n} AS n" for y, cs in (P.TRANSACTION_TARGETS if txn else P.OTHER_TARGETS).items() for c, n in cs.items())
    pool = f"SELECT id, text, sender, {_YEAR} AS year, {cat} AS cat FROM {_funnel(BANK_SQL)} AS x WHERE text IS NOT NULL AND {kept} AND substr(text, 1, 80) NOT IN (SELECT substr(sms, 1, 80) FROM gold WHERE sms IS NOT NULL)"
    return f"(SELECT p.id, p.text, p.sender FROM ({pool}) AS p JOIN ({wanted}) AS t ON p.year = t.year AND p.cat = t.cat QUALIFY row_number() OVER (PARTITION BY p.year, p.cat ORDER BY md5('42' || p.text || p.id::VARCHAR)) <= t.n)"


@register(
    "set1_expanded_gold",
    f"SELECT text AS sms, coalesce(sender, 'nan') AS sender, true AS is_txn, {', '.join(_FIELDS)} FROM {_drawn(True)} AS d JOIN ({_extract_sql()}) AS e ON d.id = e.id "
    f"UNION ALL SELECT text, coalesce(sender, 'nan'), false, NULL, NULL, NULL, NULL, NULL FROM {_drawn(False)} AS d",
)
def set1(spark, d):
    """FLT6, FLT7, JOIN3, WIN4, FN1, SET1 and SHF1 together, on the bank messages; the expected answers read again."""
    new = G.expanded(bank_messages(spark, d), table(spark, d, "gold"))
    return new.select("sms", "sender", "is_txn", F.from_json("expected", X.RECORD.removeprefix("struct<").removesuffix(">").replace(":", " ")).alias("x")).select("sms", "sender", "is_txn", *(f"x.{f}" for f in _FIELDS))


@register(
    "agg16_totals",
    f"SELECT 'transaction' AS kind, count(e.id)::BIGINT AS selected, (count(*) - count(e.id))::BIGINT AS failed FROM {_drawn(True)} AS d LEFT JOIN ({_extract_sql()}) AS e ON d.id = e.id HAVING count(*) > 0 "
    f"UNION ALL SELECT 'other', count(*)::BIGINT, 0::BIGINT FROM {_drawn(False)} AS d HAVING count(*) > 0",
)
def agg16(spark, d):
    """How many new gold rows of either kind there are, and how many drawn transactions no extractor reads."""
    pool = G.not_in_gold(G.candidates(bank_messages(spark, d)), table(spark, d, "gold"))
    drawn = G.stratified(pool.where("is_txn"), G.targets(spark, P.TRANSACTION_TARGETS)).select(F.lit("transaction").alias("kind"), X.which_extractor(F.col("text")).isNotNull().alias("read"))
    other = G.stratified(pool.where("NOT is_txn"), G.targets(spark, P.OTHER_TARGETS)).select(F.lit("other").alias("kind"), F.lit(True).alias("read"))
    return drawn.unionByName(other).groupBy("kind").agg(F.count_if("read").alias("selected"), F.count_if(~F.col("read")).alias("failed"))


@register("smp1_sample", f"SELECT id FROM (SELECT id, text FROM {_funnel()} AS f WHERE s5_not_collect) ORDER BY md5('42' || text || id::VARCHAR) LIMIT 20")
def smp1(spark, d):
    final = N.funnel(table(spark, d, "all_sms")).where("s5_not_collect")
    return final.orderBy(G.draw_key("42", F.col("text"), F.col("id"))).limit(20).select("id")


@register("shf1_shuffled", "SELECT item_id, row_number() OVER (ORDER BY md5('7' || coalesce(sms, '') || item_id::VARCHAR))::INTEGER AS place FROM gold")
def shf1(spark, d):
    from pyspark.sql import Window

    key = G.draw_key("7", F.col("sms"), F.col("item_id"))
    return table(spark, d, "gold").select("item_id", F.row_number().over(Window.orderBy(key)).alias("place"))

