"""Queries that go through files, data sources and streams and come back whole."""

from __future__ import annotations

import sqlite3
import struct

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from marlstone.operators import answers as A
from marlstone.operators import funnel as N
from marlstone.operators import runs as R
from marlstone.plans.evaluation import ORACLES as EVALUATION
from marlstone.plans.evaluation import catalogue
from marlstone.plans.messages import _counts, _funnel
from marlstone.session import put, scratch, table
from marlstone.sources import files, gguf, sqlite
from marlstone.sources.paths import opened
from marlstone.sources.report import html
from marlstone.streaming import funnel as stream

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
_SMS = "SELECT id, date, sender, text, is_from_me, service FROM all_sms"


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@register("src3_csv", _SMS)
def src3(spark, d):
    """SNK1 and SRC3: messages with quotes and line breaks out to CSV and in again."""
    path = scratch(spark, "csv")
    files.write_csv(table(spark, d, "all_sms").select("id", "date", "sender", "text", "is_from_me", "service"), path)
    return files.read_csv(spark, path)


@register("src5_json_lines", "SELECT sample_id, run_id, doc_id, target, resps[1][1] AS response FROM samples")
def src5(spark, d):
    """SNK6 and SRC5."""
    path = scratch(spark, "jsonl")
    files.write_json_lines(table(spark, d, "samples").select("sample_id", "run_id", "doc_id", "doc", "target", "resps", "filtered_resps"), path)
    return files.read_json_lines(spark, path, files.SAMPLES).select("sample_id", "run_id", "doc_id", "target", A.first_response(F.col("resps")).alias("response"))


@register("snk4_append_json_lines", "SELECT sms, sender, expected FROM gold UNION ALL SELECT sms, sender, expected FROM gold")
def snk4(spark, d):
    """SET1 and SNK4: a corpus appended to."""
    path, g = scratch(spark, "corpus"), table(spark, d, "gold").select("sms", "sender", "expected")
    files.write_json_lines(g, path)
    files.write_json_lines(g, path, append=True)
    return files.read_json_lines(spark, path, files.GOLD)


@register("src4_json_array", "SELECT item_id, sms, expected FROM gold")
def src4(spark, d):
    """SNK2 and SRC4: one JSON array in a file."""
    path = scratch(spark, "array")
    g = table(spark, d, "gold").select("item_id", "sms", "expected")
    # The gold set is the one table written as a single array; it is a fixed evaluation set.
    g.agg(F.to_json(F.collect_list(F.struct("item_id", "sms", "expected")), {"ignoreNullFields": "false"}).alias("value")).write.text(path)
    return files.read_json_array(spark, path, "item_id bigint, sms string, expected string")


@register("src7_split_sheets", f"SELECT CASE WHEN s5_not_collect THEN 'likely_transactions' ELSE 'non_transactions' END AS split, count(*)::BIGINT AS n FROM {_funnel()} AS f GROUP BY 1")
def src7(spark, d):
    """SNK3 and SRC7: the last stage's two sides, written as folders, read by name."""
    path = scratch(spark, "sheets")
    N.write_splits(N.funnel(table(spark, d, "all_sms")), path)
    both = [spark.read.parquet(f"{path}/stage=s5_not_collect/split={s}").select(F.lit(s).alias("split")) for s in ("likely_transactions", "non_transactions") if _exists(spark, f"{path}/stage=s5_not_collect/split={s}")]
    out = both[0]
    for x in both[1:]:
        out = out.unionByName(x)
    return out.groupBy("split").agg(F.count("*").alias("n"))


def _exists(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


@register("src6_run_directories", "SELECT replace(model_id, '/', '__') || '_' || run_id AS slug, quant, n_ctx FROM runs WHERE run_id IN (SELECT run_id FROM samples) AND run_id <> 'run02'")
def src6(spark, d):
    """SRC6, SET4, JOIN4: results below two roots; an unreadable result and one without samples are left out."""
    import json

    roots, runs = [scratch(spark, "root"), scratch(spark, "root")], table(spark, d, "runs")
    with_samples = {r["run_id"] for r in runs.join(table(spark, d, "samples").select("run_id").distinct(), "run_id", "left_semi").collect()}
    for k, r in enumerate(runs.orderBy("run_id").collect()):  # a configuration table of a few dozen rows
        at = f"{roots[k % 2]}/{r['model_id'].replace('/', '__')}_{r['run_id']}"
        body = {"model_id": r["model_id"], "quant": r["quant"], "n_ctx": r["n_ctx"], "metrics": {"full_match_accuracy,none": 0.5}}
        put(spark, f"{at}/results_{r['run_id']}.json", (json.dumps(body) if r["run_id"] != "run02" else '{"model_id": ').encode())
        if r["run_id"] in with_samples:
            put(spark, f"{at}/samples_{r['run_id']}.jsonl", b"{}\n")
    return files.read_runs(spark, *roots).select("slug", "quant", "n_ctx")


_MESSAGE = "rowid date handle_id text is_from_me service".split()
_SCAN = "SELECT m.rowid AS id, m.date, CASE WHEN m.is_from_me = 1 THEN 'me' ELSE h.id END AS sender, m.text, coalesce(m.service, '') AS service {} FROM message m LEFT JOIN handle h ON m.handle_id = h.rowid WHERE m.date > 0"


@register("src1_sqlite", _SCAN.format(""))
def src1(spark, d):
    """SRC1: the message scan with its join, CASE and filter, run by SQLite over files of messages in ranges.

    Each task writes its own messages into a file of the shared folder; the handles, a table of fixed size, go into all.
    """
    handles, at = [tuple(r) for r in table(spark, d, "handle").select("rowid", "id").collect()], scratch(spark, "databases")

    def write(batches):
        con = sqlite3.connect(":memory:")
        con.execute("CREATE TABLE handle (rowid INTEGER, id TEXT)")
        con.execute(f"CREATE TABLE message ({', '.join(_MESSAGE)})")
        con.executemany("INSERT INTO handle VALUES (?, ?)", handles)
        for b in batches:
            con.executemany(f"INSERT INTO message VALUES ({', '.join('?' * len(_MESSAGE))})", zip(*(c.to_pylist() for c in b.columns)))
        con.commit()
        path = f"{at}/part-{TaskContext.get().partitionId()}.db"
        system, inside = opened(path)
        system.create_dir(inside.rpartition("/")[0], recursive=True)
        with system.open_output_stream(inside) as f:
            f.write(con.serialize())
        yield pa.RecordBatch.from_pydict({"path": pa.array([path])})

    table(spark, d, "message").select(*_MESSAGE).mapInArrow(write, "path string").count()
    sqlite.register(spark)
    options = {"path": at, "query": _SCAN.format(", m._rowid_ AS k"), "key": "k", "partitions": "4"}
    return spark.read.format("sqlite").schema("id bigint, date bigint, sender string, text string, service string").options(**options).load()


def _header(n: int) -> bytes:
    """A header with a string, an array, a 64-bit number and then the context length."""
    s = lambda x: struct.pack("<Q", len(x)) + x
    kv = s(b"general.name") + struct.pack("<I", 8) + s(b"x") + s(b"tokens") + struct.pack("<IIQ", 9, 8, 2) + s(b"a") + s(b"bc") + s(b"n") + struct.pack("<IQ", 10, 7)
    return b"GGUF" + struct.pack("<IQQ", 3, 0, 4) + kv + s(b"m.context_length") + struct.pack("<II", 4, n)


@register("src8_weight_headers", "SELECT run_id, n_ctx AS context_length FROM runs")
def src8(spark, d):
    """SRC8: headers of weight files, one for each run of a configuration table."""
    at = scratch(spark, "weights")
    for r in table(spark, d, "runs").select("run_id", "n_ctx").collect():
        put(spark, f"{at}/{r['run_id']}.gguf", _header(r["n_ctx"]))
    gguf.register(spark)
    return spark.read.format("gguf").load(f"{at}/*.gguf").select(F.regexp_extract("path", r"([^/]+)\.gguf$", 1).alias("run_id"), "context_length")


@register("src11_file_sizes", "SELECT fileid AS path, octet_length(encode(coalesce(relativepath, ''))) / 1048576.0::DOUBLE AS mb FROM backup_files UNION ALL SELECT 'absent', 0.0")
def src11(spark, d):
    """SRC11: sizes of files in a folder, those of a table of fixed size, and of one that isn't there."""
    at, rows = scratch(spark, "sized"), table(spark, d, "backup_files").select("fileid", "relativepath").collect()
    for r in rows:
        put(spark, f"{at}/{r['fileid']}", (r["relativepath"] or "").encode())
    f = files.listing(spark, at).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("path"), "modified_at", "bytes")
    return files.size_mb(spark.createDataFrame([(r["fileid"],) for r in rows] + [("absent",)], "path string"), f)


@register(
    "snk5_report",
    f"SELECT (2 + (SELECT count(*) FROM ({EVALUATION['agg13_leaderboard']})) + (SELECT count(DISTINCT doc_id) FROM samples WHERE sample_id IN ({EVALUATION['win3_interleaved']})) "
    f"* (SELECT count(*) FROM ({EVALUATION['win1_latest_run']})))::INTEGER AS n_rows, true AS rendered",
)
def snk5(spark, d):
    """SNK5: the rendered report's size, beside the number of runs in it."""
    s, runs = table(spark, d, "samples"), table(spark, d, "runs")
    board = R.leaderboard(catalogue(spark, d))
    page = html(board, R.viewer(R.interleaved(s), R.latest(runs), s), list(A.METRICS))
    return spark.createDataFrame([(page.count("<tr>"), len(page) > 1000)], "n_rows int, rendered boolean")


@register("stream_funnel_counts", _counts("all_sms"))
def stream_funnel_counts(spark, d):
    """The funnel as a stream over the message files, everything that has arrived."""
    name = "all_sms.parquet"
    at = f"{d}/{name}"
    # A table is a file or, as Spark writes it, a folder of files.
    system, inside = opened(at)
    path, glob = (at, "*.parquet") if not system.get_file_info(inside).is_file else (d, name)
    schema = table(spark, d, "all_sms").schema
    out, checkpoint = scratch(spark, "stream-out"), scratch(spark, "stream-checkpoint")
    stream.append(stream.flagged(stream.arriving(spark, path, schema, glob)), out, checkpoint).awaitTermination()
    return N.stage_counts(spark.read.parquet(out))

