"""Queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.copies import copies
from marlstone.llm.cuts import by_source, cut
from marlstone.llm.encoding import garbled
from marlstone.llm.leaks import index, leaks, proximity
from marlstone.llm.lookalikes import unified
from marlstone.llm.packing import fill, packed
from marlstone.llm.pairs import defects, labelled
from marlstone.llm.personal import personal_types, redacted
from marlstone.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled(table(spark, sf_dir, "all_sms")).select("id")


def p1_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled(table(spark, sf_dir, "all_sms"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_types(table(spark, sf_dir, "all_sms"))


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redacted(table(spark, sf_dir, "all_sms"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unified(table(spark, sf_dir, "all_sms")).select("id")


def p4_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unified(table(spark, sf_dir, "all_sms"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(table(spark, sf_dir, "all_sms"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defects(table(spark, sf_dir, "samples"), table(spark, sf_dir, "gold"), table(spark, sf_dir, "documents"))


def p6_by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many samples of each run have each defect, by field."""
    found = labelled(table(spark, sf_dir, "samples"), table(spark, sf_dir, "gold"), table(spark, sf_dir, "documents"))
    return found.join(table(spark, sf_dir, "samples").select("sample_id", "run_id"), "sample_id").groupBy("run_id", "field", "defect").agg(F.countDistinct("sample_id").alias("n"))


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "context_windows"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that the packing had to split: one row for each capacity."""
    return p7_packed(spark, sf_dir).where("n_pieces > 1 AND piece = 0").select("doc_id", "window_id")


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill(p7_packed(spark, sf_dir), table(spark, sf_dir, "context_windows"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "gold"))


def p8_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proximity(index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "gold"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(table(spark, sf_dir, "documents")).select("doc_id")


def p9_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_source(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p1_found": p1_found, "p1_restored": p1_restored, "p3_found": p3_found, "p3_redacted": p3_redacted, "p4_found": p4_found, "p4_unified": p4_unified, "p5_found": p5_found, "p6_found": p6_found, "p6_by_run": p6_by_run,
    "p7_found": p7_found, "p7_packed": p7_packed, "p7_fill": p7_fill, "p8_found": p8_found, "p8_matches": p8_matches, "p9_found": p9_found, "p9_by_source": p9_by_source}
_GRAM = r"SELECT DISTINCT {i}, array_to_string(w[k : k + 11], ' ') AS gram FROM (SELECT {i}, w, unnest(range(1, len(w) - 10)) AS k FROM (SELECT {i}, regexp_extract_all(lower({t}), '[\p{{L}}\p{{N}}]+') AS w FROM {s}))"
_BARE = "replace(upper(regexp_replace({}, '[^\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Sc}}]+', '', 'g')), 'ẞ', 'SS')".replace("\\\\", "\\")
_LABEL = r"((?:^|[\t\n\x0b\f\r \x{85}\p{Z};,/|]+))([\p{L}\p{M}\p{Nl}]+(?:/[\p{L}\p{M}\p{Nl}]+)?[\t\n\x0b\f\r \x{85}\p{Z}]*:)"
_PARTS = f"string_split(regexp_replace(replace(text, '://', chr(2)), '{_LABEL}', chr(1) || '\\2', 'g'), chr(1))"
_LABELLED = "len(regexp_extract_all(replace(text, '://', chr(2)), '" + _LABEL + "')) >= 2"
_KEY = f"CASE WHEN {_LABELLED} THEN {_BARE.format('p[1]')} || array_to_string(list_sort(list_transform(p[2:], lambda x: {_BARE.format('x')})), '') ELSE {_BARE.format('text')} END"

ORACLES: dict[str, str] = {
    "p5_found": f"SELECT min(id) AS id, count(*)::BIGINT AS n_copies FROM (SELECT id, {_KEY} AS k, {_BARE.format('sender')} AS s FROM (SELECT *, {_PARTS} AS p FROM all_sms WHERE text <> '' AND sender <> '')) GROUP BY k, s HAVING count(*) > 1",
    "p7_found": "SELECT doc_id, window_id FROM documents, context_windows WHERE octet_length(encode(text)) > n_ctx",
    "p8_found": f"SELECT DISTINCT doc_id, item_id FROM ({_GRAM.format(i='doc_id', t='text', s='documents')}) JOIN ({_GRAM.format(i='item_id', t='sms', s='gold')}) USING (gram)",
}
