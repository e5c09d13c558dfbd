from datetime import datetime, timezone

import pytest

from marlstone.operators.instants import InstantDictionary, instants, parse_instant
from marlstone.session import scratch


def us(*args, f=0):
    return int(datetime(*args, tzinfo=timezone.utc).timestamp()) * 1_000_000 + f


CASES = [
    ("2023-01-01 07:12:50", "Asia/Kolkata", "en_IN", us(2023, 1, 1, 1, 42, 50)),
    ("2023-01-01T07:12:50.1234569", "UTC", "", us(2023, 1, 1, 7, 12, 50, f=123456)),
    ("2023-01-01t07:01:10z", "Asia/Kolkata", "", us(2023, 1, 1, 7, 1, 10)),
    ("2023-01-01T10:04:28+01", "America/New_York", "", us(2023, 1, 1, 9, 4, 28)),
    ("Sun, 01 Jan 2023 13:00:48 +0530", "", "", us(2023, 1, 1, 7, 30, 48)),
    ("07-Jan-2023 06:40:14 EST", "America/New_York", "en_US", us(2023, 1, 7, 11, 40, 14)),
    ("10-Feb-2023 16:37:57 GST", "Asia/Dubai", "", us(2023, 2, 10, 12, 37, 57)),
    ("2023-01-06T21:39:55[America/New_York]", "Asia/Kolkata", "", us(2023, 1, 7, 2, 39, 55)),
    ("2023-01-01 14:48:38 America/New_York", "", "", us(2023, 1, 1, 19, 48, 38)),
    ("01 Jan 2023 00:11 UTC", "Asia/Kolkata", "", us(2023, 1, 1, 0, 11)),
    ("20230101T084638Z", "", "", us(2023, 1, 1, 8, 46, 38)),
    # the month is first for en_US only
    ("6/10/2024, 2:35 PM", "UTC", "en_US", us(2024, 6, 10, 14, 35)),
    ("6/10/2024, 2:35 PM", "UTC", "en_GB", us(2024, 10, 6, 14, 35)),
    ("24.10.23, 13:03", "Europe/Berlin", "de_DE", us(2023, 10, 24, 11, 3)),
    ("5.51am 16/Dec/2023", "UTC", "", us(2023, 12, 16, 5, 51)),
    ("19:21 on 11 Feb 2026", "UTC", "", us(2026, 2, 11, 19, 21)),
    ("Oct 26, 2023 at 12:37 AM IST", "Asia/Kolkata", "", us(2023, 10, 25, 19, 7)),
    ("18Nov25 18:21", "UTC", "", us(2025, 11, 18, 18, 21)),
    # a time that occurs twice is the first; a skipped one has the offset before the change
    ("2024-11-03 01:30:00", "America/New_York", "", us(2024, 11, 3, 5, 30)),
    ("2024-03-10 02:30:00", "America/New_York", "", us(2024, 3, 10, 7, 30)),
    ("2024-11-03 01:30:00 EST", "America/New_York", "", us(2024, 11, 3, 6, 30)),
    # months in the corpus's languages, ordinals, other layouts
    ("3. Mai 2025 14:05", "Europe/Berlin", "de_DE", us(2025, 5, 3, 12, 5)), ("4 mars 2025 à 10:05", "Europe/Paris", "fr_FR", us(2025, 3, 4, 9, 5)), ("5 de marzo de 2025 a las 18:00", "UTC", "es_ES", us(2025, 3, 5, 18)),
    ("1er août 2024 08:00", "UTC", "", us(2024, 8, 1, 8)), ("12. März 2024 um 07:15", "UTC", "", us(2024, 3, 12, 7, 15)), ("7 अगस्त 2025 09:30", "Asia/Kolkata", "hi_IN", us(2025, 8, 7, 4)), ("9 марта 2024 в 10:00", "UTC", "", us(2024, 3, 9, 10)),
    ("Tue Mar 04 10:00:00 UTC 2025", "Asia/Kolkata", "", us(2025, 3, 4, 10)), ("2025-W10-2T10:00:00Z", "", "", us(2025, 3, 4, 10)), ("2025-063T10:00", "UTC", "", us(2025, 3, 4, 10)), ("March 4th, 2025 at 10:00 am", "UTC", "", us(2025, 3, 4, 10)),
    # length decides nothing
    ("2023-01-01" + " " * 100_000 + "07:12:50 UTC", "", "", us(2023, 1, 1, 7, 12, 50)),
    ("3 jui 2025 10:00", "UTC", "", None), ("2025-W60-1 10:00", "UTC", "", None), ("2025-366 10:00", "UTC", "", None), ("3 foo 2025 10:00", "UTC", "", None),
    # bare numbers: both epochs, four units
    ("1672555515", "", "", 1672555515000000), ("1672534465739", "", "", 1672534465739000), ("1672627264372056", "", "", 1672627264372056),
    ("694253619669009948", "", "", 978307200000000 + 694253619669009), ("694253619", "", "", 978307200000000 + 694253619000000), ("1672555515.25", "", "", 1672555515250000),
    # no instants
    *((x, "UTC", "", None) for x in (None, "", " ", "unknown", "n/a", "--", "31/02/2025 10:00", "2024-13-05T10:00:00", "0000-00-00 00:00:00", "2024-01-01", "12:30", "99999999999", "2024-01-01 25:00", "1" * 5000, "13:30 pm 1 Jan 2024")),
    ("2023-01-01 07:12:50", None, None, None), ("2023-01-01 07:12:50 XYZ", "UTC", "", None), ("2023-01-01 07:12:50 Nowhere/Town", "UTC", "", None),
]


@pytest.mark.parametrize("raw,zone,locale,want", CASES)
def test_parse(raw, zone, locale, want):
    assert parse_instant(raw, zone, locale) == want


def test_rows(spark):
    rows = [
        (1, "2023-01-01 07:12:50", "paid at ２０２３-01-02 09:00 IST, ref 9", "f"),
        (2, "2023-01-01T07:12:50.000000Z", "on 19-08-23 by A, rs 5129.30 on 19-08-23", "f"),
        (3, None, None, None),
        (4, "2023-01-01 07:12:50", "", "g"),
        (5, "2023-01-01T07:12:50+00:00", "x" * 200_000 + " 2023-01-02T09:00:00Z", None),
        (5, "2023-01-01T07:12:50+00:00", "", None),
        *((100 + k, "1672555515", "t", "f") for k in range(50)),
    ]
    m = spark.createDataFrame(rows, "id bigint, date string, text string, fileid string").selectExpr("*", "'a' AS raw", "'b' AS tz", "1 AS utc_us")
    b = spark.createDataFrame([("f", "Asia/Kolkata", "en_IN"), ("g", None, None), ("f", "Asia/Kolkata", "en_IN")], "fileid string, tz string, locale string")
    got = sorted(tuple(r) for r in instants(m, b).where("id < 100").collect())
    assert got == [(1, "date", us(2023, 1, 1, 1, 42, 50)), (1, "text", us(2023, 1, 2, 3, 30)), (5, "date", us(2023, 1, 1, 7, 12, 50)), (5, "date", us(2023, 1, 1, 7, 12, 50)), (5, "text", us(2023, 1, 2, 9, 0))]
    assert instants(m, b).where("id >= 100").count() == 50
    assert instants(m.limit(0), b).count() == 0 and instants(m, b.limit(0)).where("id = 1").count() == 0 + 1  # a zone in the text still counts


def test_dictionary_only_grows(spark):
    book = InstantDictionary(spark, scratch(spark, "book"))
    one = spark.createDataFrame([("1672555515", None, None), ("1672555515", None, None), (None, None, None)], "raw string, zone string, locale string")
    two = spark.createDataFrame([("1672555515", None, None), ("nothing", "UTC", "")], "raw string, zone string, locale string")
    assert book.update(one).table().count() == 1
    assert sorted((r["raw"], r["utc_us"]) for r in book.update(two).update(two).table().collect()) == [("1672555515", 1672555515000000), ("nothing", None)]
    assert book.resolve(two).where("utc_us IS NULL").count() == 1


def test_dictionary_is_kept_between_calls(spark, monkeypatch):
    """A second, larger input through one dictionary: only values that the first lacked are parsed."""
    from marlstone.operators import instants as module

    rows = [(k, f"2024-01-{k % 28 + 1:02d} 10:{k % 60:02d}:00", f"seen 4 Mai 2024 11:{k % 60:02d}", "f") for k in range(200)]
    m = spark.createDataFrame(rows, "id bigint, date string, text string, fileid string")
    b = spark.createDataFrame([("f", "Asia/Tokyo", "ja_JP")], "fileid string, tz string, locale string")
    path = scratch(spark, "kept")
    small, counts = instants(m.where("id < 50"), b, path).count(), []
    book = InstantDictionary(spark, path)
    before = book.table().where("zone = 'Asia/Tokyo'").count()
    parse = module._parsed
    monkeypatch.setattr(InstantDictionary, "update", lambda self, x, was=InstantDictionary.update: (was(self, x), counts.append(self.table().where("zone = 'Asia/Tokyo'").count()))[0])
    assert instants(m, b, path).count() == 400 and small == 100 and parse is module._parsed
    distinct = len({r[1] for r in rows}) + len({r[2][5:] for r in rows})
    assert counts == [distinct] and before < distinct
    assert InstantDictionary(spark).path == InstantDictionary(spark).path != path  # by itself it is in the shared folder
    # No value was parsed twice.
    assert spark.read.parquet(book.path).where("zone = 'Asia/Tokyo'").count() == distinct


def test_two_writers_of_one_value_do_not_double_rows(spark):
    book = InstantDictionary(spark, scratch(spark, "book"))
    one = spark.createDataFrame([("1672555515", "", "")], "raw string, zone string, locale string")
    book.update(one)
    spark.read.parquet(book.path).coalesce(1).write.mode("append").parquet(book.path)
    assert book.table().count() == 1 and book.resolve(one).count() == 1
