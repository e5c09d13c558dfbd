import sqlite3
import struct
from io import BytesIO

import pytest
from pyspark.sql import functions as F

from marlstone.operators import ingest as I
from marlstone.operators.predict import RulePredictor, TwoPhase, predicted, prompt, without_bos
from marlstone.plans.connectors import _header
from marlstone.session import bounded_broadcast, scratch
from marlstone.sources import files, gguf, sqlite
from marlstone.sources.paths import found
from marlstone.sources.report import html
from marlstone.streaming import funnel as stream


def blob(data: bytes, declared: int | None = None, tail: bytes = b"\x86\x84") -> bytes:
    n = len(data) if declared is None else declared
    size = bytes([n]) if n < 0x80 else b"\x81" + struct.pack("<H", n) if n < 65536 else b"\x82" + struct.pack("<I", n)
    return b"\x04\x0bstreamtyped\x84\x84\x84NSString\x01\x94\x84\x01+" + size + data + tail


@pytest.mark.parametrize("n", [0, 1, 127, 128, 255, 65_535, 65_536])
def test_blob_lengths(spark, n):
    df = spark.createDataFrame([(bytearray(blob(b"a" * n)),)], "b binary")
    assert df.select(I.attributed_body(F.col("b"))).first()[0] == "a" * n


def test_damaged_blobs(spark):
    whole = blob("é₹".encode())
    rows = [(whole, "é₹"), (whole[: whole.index(b"+") + 1], None), (whole[:20], None), (b"NSString no mark", None), (None, None), (b"", None), (blob(b"a\xffb"), "a�b"), (blob(b"abc", 100, b""), "abc"), (b"NSString\x01+\x90x", None), (b"NSString\x01+\x81\x05", None)]
    df = spark.createDataFrame([(k, None if b is None else bytearray(b)) for k, (b, _) in enumerate(rows)], "k int, b binary")
    assert {r["k"]: r["t"] for r in df.select("k", I.attributed_body(F.col("b")).alias("t")).collect()} == {k: t for k, (_, t) in enumerate(rows)}


def test_export(spark):
    m = spark.createDataFrame(
        [(1, 694224000861643456, 7, "hi", None, 0, "SMS"), (2, 0, 7, "no date", None, 0, "SMS"), (3, 5, None, " ", bytearray(blob(b"in blob")), 0, None), (4, 5, 8, None, None, 1, "SMS"), (5, 5, 8, "mine", None, 1, "SMS"), (1, 694224000861643456, 7, "hi", None, 0, "SMS")],
        "rowid bigint, date bigint, handle_id bigint, text string, attributedbody binary, is_from_me int, service string",
    ).selectExpr("*", "'z' AS handle", "1 AS id")
    h = spark.createDataFrame([(7, "VM-X")], "rowid bigint, id string")
    got = sorted((r["id"], r["sender"], r["text"], r["service"], str(r["date"])) for r in I.exported(m, h).collect())
    assert got == [(1, "VM-X", "hi", "SMS", "2023-01-01 00:00:00.861643")] * 2 + [(3, "", "in blob", "", "2001-01-01 00:00:00"), (5, "me", "mine", "SMS", "2001-01-01 00:00:00")]
    assert tuple(I.provenance(m).first()) == (5, 3, 1, 1)
    assert I.exported(m.limit(0), h).count() == 0


def test_sqlite_in_ranges(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "a.db")
    con.execute("CREATE TABLE t (ROWID INTEGER PRIMARY KEY, s TEXT, b BLOB)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?)", [(k * 3, None if k == 5 else f"s{k}", b"x") for k in range(1, 50)])
    con.execute("CREATE TABLE e (s TEXT)")
    con.commit()
    sqlite.register(spark)
    read = lambda t, n: spark.read.format("sqlite").schema("s string").options(path=str(tmp_path / "a.db"), dbtable=t, partitions=str(n)).load()
    assert sorted(r["s"] or "" for r in read("t", 4).collect()) == sorted(["" if k == 5 else f"s{k}" for k in range(1, 50)])
    assert read("t", 4).rdd.getNumPartitions() == 4 and read("e", 3).count() == 0


def test_sqlite_query_over_a_folder(spark, tmp_path):
    """Join, CASE and filter run in SQLite, in ranges of each file of a folder."""
    for part in range(3):
        con = sqlite3.connect(tmp_path / f"p{part}.db")
        con.execute("CREATE TABLE handle (rowid INTEGER, id TEXT)")
        con.execute("CREATE TABLE message (rowid INTEGER, date INTEGER, handle_id INTEGER, is_from_me INTEGER)")
        con.execute("INSERT INTO handle VALUES (7, 'VM-X')")
        con.executemany("INSERT INTO message VALUES (?, ?, ?, ?)", [(part * 100 + k, k % 4, 7 if k % 3 else None, k % 2) for k in range(40)])
        con.commit()
    query = "SELECT m.rowid AS id, CASE WHEN m.is_from_me = 1 THEN 'me' ELSE h.id END AS sender, m._rowid_ AS k FROM message m LEFT JOIN handle h ON m.handle_id = h.rowid WHERE m.date > 0"
    sqlite.register(spark)
    for path in (str(tmp_path), f"file://{tmp_path}/*.db"):
        df = spark.read.format("sqlite").schema("id bigint, sender string").options(path=path, query=query, key="k", partitions="2").load()
        want = [(p * 100 + k, "me" if k % 2 else "VM-X" if k % 3 else None) for p in range(3) for k in range(40) if k % 4]
        assert sorted((tuple(r) for r in df.collect()), key=lambda x: x[0]) == want and df.rdd.getNumPartitions() == 6


def test_finding_files(tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    for name in ("x.gguf", "a/y.gguf", "a/b/z.gguf", "a/b/n.txt"):
        (tmp_path / name).write_bytes(b"")
    at = str(tmp_path)
    assert found(f"{at}/x.gguf") == [f"{at}/x.gguf"] and found(f"{at}/none") == [] and found(f"{at}/none/*") == []
    assert found(f"{at}/**/*.gguf") == sorted(f"{at}/{n}" for n in ("x.gguf", "a/y.gguf", "a/b/z.gguf"))
    assert len(found(at)) == 4 and found(f"file://{at}/a/b/*.txt") == [f"file://{at}/a/b/n.txt"]


def test_times(spark):
    rows = ["2024-01-02T03:04:05", "2024-01-02 03:04:05.123456", "2024-13-02T03:04:05", "2024-01-02", "1704164645", "1704164645.5", "99999999999999999999", "x", "", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "k int, t string")
    got = {r["k"]: (r["iso"] and str(r["iso"]), r["epoch"] and str(r["epoch"])) for r in df.select("k", I.iso_time(F.col("t")).alias("iso"), I.epoch_seconds(F.col("t")).alias("epoch")).collect()}
    none = (None, None)
    assert got == dict(enumerate([("2024-01-02 03:04:05", None), ("2024-01-02 03:04:05.123456", None), none, none, (None, "2024-01-02 03:04:05"), (None, "2024-01-02 03:04:05.500000"), none, none, none, none]))


def test_gguf_headers(spark, tmp_path):
    assert gguf.context_length(BytesIO(_header(4096))) == 4096
    for bad in (b"", b"GGUF", b"XXXX" + _header(1)[4:], _header(1)[:-2], b"GGUF" + struct.pack("<I", 9) + _header(1)[8:]):
        assert gguf.context_length(BytesIO(bad)) is None
    (tmp_path / "m.gguf").write_bytes(_header(8192) + b"\0" * 1000)
    gguf.register(spark)
    assert [r["context_length"] for r in spark.read.format("gguf").load(str(tmp_path / "*.gguf")).collect()] == [8192]


def test_files_by_size_and_time(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"x" * 2048)
    (tmp_path / "b.bin").write_bytes(b"x")
    f = files.listing(spark, str(tmp_path), "*.bin")
    assert files.smallest(f).first()["path"].endswith("b.bin") and files.newest(f).first()["path"].endswith(".bin")
    asked = f.select("path").unionByName(spark.createDataFrame([("none",)], "path string"))
    assert sorted(r["mb"] for r in files.size_mb(asked, f).collect()) == [0.0, 1 / 1048576, 2048 / 1048576]
    files.copy(spark, f"file://{tmp_path}/b.bin", f"file://{tmp_path}/c.bin")
    assert (tmp_path / "c.bin").read_bytes() == b"x"


def test_csv_round_trip(spark):
    rows = [(1, "d", 'a "b"\nc', "", True, None), (2, None, None, " x ", False, "SMS"), (3, "d", "é,₹", "\\N x", None, "")]
    df = spark.createDataFrame(rows, files.SMS)
    path = scratch(spark, "csv")
    files.write_csv(df, path)
    assert sorted(tuple(r) for r in files.read_csv(spark, path).collect()) == rows


def test_predictor_hook(spark):
    df = spark.createDataFrame([(1, "Rs.5 debited at A/c XX1234 toward Oak Shop"), (2, "hello"), (3, None)], "doc_id bigint, sms string")
    p = df.select("doc_id", prompt(F.lit("X"), F.col("sms")).alias("prompt"))
    got = {r["doc_id"]: r["response"] for r in predicted(p, RulePredictor).collect()}
    assert got[1] == '{"amount": 5.0, "counterparty": "Oak Shop", "type": "debit", "account": "A/c XX1234"}' and got[2] == "null" and got[3] is None
    assert TwoPhase(lambda p: "<think>hm</think> more", lambda p: "null")("x") == "<think>hm</think>\nnull"
    assert df.select(without_bos(F.lit("<s>hi"), "<s>"), without_bos(F.lit("hi"), "<s>")).first()[0:2] == ("hi", "hi")
    assert predicted(p.limit(0), RulePredictor).count() == 0


def test_broadcast_only_within_the_bound(spark):
    small, large = (bounded_broadcast(spark.range(n), 10) for n in (10, 11))
    plan = lambda d: d._jdf.queryExecution().logical().toString()
    assert "Hint" in plan(small) and "Hint" not in plan(large)


def test_report_escapes(spark):
    board = spark.createDataFrame([(1, "<m>", "Q", 0, 0.5, ["mid"], ["x"], [])], "rank int, model_id string, quant string, thinking_budget int, x double, badges array<string>, best array<string>, worst array<string>")
    cells = spark.createDataFrame([(1, "m", "r", "match", "<b>")], "doc_id int, model_id string, run_id string, verdict string, answer string")
    page = html(board, cells, ["x"])
    assert "&lt;m&gt;" in page and "&lt;b&gt;" in page and 'class="best">0.500' in page


def test_stream_takes_each_file_once(spark):
    source, out, mark = scratch(spark, "in"), scratch(spark, "out"), scratch(spark, "mark")
    schema = "id bigint, sender string, text string"
    for k in range(2):
        spark.createDataFrame([(k, "56012", "Rs.5 debited a/c x1"), (10 + k, "me", "x")], schema).coalesce(1).write.mode("append").parquet(source)
        stream.append(stream.flagged(stream.arriving(spark, source, spark.read.parquet(source).schema)), out, mark).awaitTermination()
        assert sorted(r["id"] for r in spark.read.parquet(out).where("s5_not_collect").collect()) == list(range(k + 1))
