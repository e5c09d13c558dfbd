"""Mixed timestamp formats and time zones: one UTC instant for each mention.

Raw strings are de-duplicated together with their zone and locale into a dictionary of distinct values, each value is
parsed once by every known form, the dictionary is kept as a table that later calls only add to, and the instants are
joined back to the rows. 100 copies of a raw string cost one parse; the parser runs over the dictionary, never over rows.
The dictionary stays in the shared folder under a name of the parser's own, so a later call, or a later driver, parses
only values that none before it has seen; a changed parser starts a new one.
"""

from __future__ import annotations

import hashlib
import inspect
import re
import sys
from collections.abc import Iterator
from datetime import datetime, timedelta
from functools import lru_cache
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.text import let
from marlstone.functions.textfold import ascii_fold, ascii_tables
from marlstone.session import bounded_broadcast, require, shared_dir, written

EPOCH = datetime(1970, 1, 1)
APPLE_EPOCH_S = 978_307_200
#: Bare numbers must fall into these years.
FIRST_US = 1_640_995_200_000_000
END_US = 1_798_761_600_000_000

#: The form that needs no change.
NORMAL_FORM = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{6}Z$"

# Month names of the corpus's languages and their neighbours, from January on.
MONTHS = {
    "en": "january february march april may june july august september october november december",
    "de": "januar februar märz april mai juni juli august september oktober november dezember",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    "pt": "janeiro fevereiro março abril maio junho julho agosto setembro outubro novembro dezembro",
    "it": "gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre novembre dicembre",
    "nl": "januari februari maart april mei juni juli augustus september oktober november december",
    "hi": "जनवरी फरवरी मार्च अप्रैल मई जून जुलाई अगस्त सितंबर अक्टूबर नवंबर दिसंबर",
    "ru": "января февраля марта апреля мая июня июля августа сентября октября ноября декабря",
    "el": "ιανουαρίου φεβρουαρίου μαρτίου απριλίου μαΐου ιουνίου ιουλίου αυγούστου σεπτεμβρίου οκτωβρίου νοεμβρίου δεκεμβρίου",
}
# Zone abbreviations and the zones they belong to (minutes east of Greenwich).
ABBREVIATIONS = {
    "utc": (0, ""), "gmt": (0, "Europe/London"), "bst": (60, "Europe/London"), "cet": (60, "Europe/"), "cest": (120, "Europe/"),
    "ist": (330, "Asia/Kolkata"), "gst": (240, "Asia/Dubai"), "est": (-300, "America/"), "edt": (-240, "America/"),
    "aest": (600, "Australia/"), "aedt": (660, "Australia/"),
}



def _month_numbers() -> dict[str, int]:
    """Each beginning of three letters or more that belongs to one month only, as written and as ``ascii_fold`` leaves it."""
    of: dict[str, set[int]] = {}
    fold = dict(zip(map(ord, ascii_tables()[0]), ascii_tables()[1]))
    for names in MONTHS.values():
        for k, name in enumerate(names.split(), 1):
            for form in {name, name.translate(fold).lower()}:
                for n in range(min(3, len(form)), len(form) + 1):
                    of.setdefault(form[:n], set()).add(k)
    return {name: next(iter(ks)) for name, ks in of.items() if len(ks) == 1}


_MONTH = _month_numbers()
_MON = "(?:" + "|".join(sorted({m[:3] if m.isascii() else m for m in _MONTH}, key=lambda m: (-len(m), m))) + r")[a-zà-ÿ]*\.?"
_ABBR = r"(?:utc|gmt|bst|cest|cet|ist|gst|est|edt|aest|aedt)"
_NTH = r"(?:\.|st|nd|rd|th|er)?"
_DATE = (
    r"(?:\d{4}[-/.]\d{2}[-/.]\d{2}|\d{1,2}[-/.]\d{1,2}[-/.](?:\d{4}|\d{2})"
    rf"|\d{{1,2}}{_NTH}[-/\s]*(?:de\s+)?{_MON}[-/\s,]*(?:del?\s+)?(?:\d{{4}}|\d{{2}})|(?<![a-zà-ÿ]){_MON}\s+\d{{1,2}}{_NTH},?\s*\d{{4}}|\d{{4}}-w\d{{2}}-[1-7])"
)
_TIME = r"(?:\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d{1,9})?)?(?:\s*[ap]\.?m\b)?|\d{1,2}\.\d{2}\s*[ap]\.?m\b)"
_ZONE = rf"(?:\s*(?:z\b|utc[+-]\d{{1,2}}\b|gmt[+-]\d{{1,2}}\b|[+-]\d{{2}}:?\d{{2}}\b|[+-]\d{{2}}\b|\[?(?:Africa|America|Asia|Australia|Europe|Pacific)/\w+(?:/\w+)?\]?|{_ABBR}\b))?"
# Words between a date and its time of day.
_AT = r"(?:\s*[,;]\s*|t|\s+(?:at|um|à|a\s+las|às|alle(?:\s+ore)?|om|को|в|στις)\s+|\s+-\s+|\s+)"
_ON = r"(?:\s+(?:on|am|le|el|del|il|em|op|-)\s+|\s*,\s*|\s+)"
#: A date with a time of day inside running text. Java and Python read it alike.
MENTION = (
    rf"(?i)(?<![\d.,:/-])(?:{_DATE}{_AT}{_TIME}{_ZONE}"
    rf"|{_TIME}{_ZONE}{_ON}{_DATE}{_ZONE}|\d{{8}}t\d{{6}}z?|\b(?:mon|tue|wed|thu|fri|sat|sun)\s+{_MON}\s+\d{{1,2}}\s+{_TIME}{_ZONE}\s+\d{{4}})"
)

CLOCK = r"(?i)\d:\d\d|\d\.\d\d\s*[ap]\.?m|\dt\d"

_T = r"(?P<H>\d{1,2})[:.](?P<M>\d{2})(?:[:.](?P<S>\d{2})(?:[.,](?P<f>\d+))?)?\s*(?P<ap>[ap]\.?m\b\.?)?"
_Z = (
    r"\s*(?:(?P<z>z)|(?:utc|gmt)?(?P<sg>[+-])(?P<oh>\d{1,2})(?::?(?P<om>\d{2}))?(?:\[[\w/+-]+\])?"
    r"|\[?(?P<reg>[a-z]+/[a-z_]+(?:/[a-z_]+)?)\]?|(?P<ab>[a-z]{3,4}))?"
)
_DAY = r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+)?"
_B = r"(?P<b>[^\s\d.,/:-]{2,12})\.?"
_D = [
    r"(?P<Y>\d{4})(?P<s>[-/.])(?P<m>\d{1,2})(?P=s)(?P<d>\d{1,2})",
    rf"{_DAY}(?P<d>\d{{1,2}}){_NTH}[-/\s]*(?:de\s+)?{_B}[-/\s,]*(?:del?\s+)?(?P<Y>\d{{4}}|\d{{2}})",
    rf"{_DAY}{_B}\s+(?P<d>\d{{1,2}}){_NTH},?\s*(?P<Y>\d{{4}})",
    r"(?P<n1>\d{1,2})(?P<s>[-/.])(?P<n2>\d{1,2})(?P=s)(?P<Y>\d{4}|\d{2})",
    r"(?P<Y>\d{4})-w(?P<w>\d{2})-(?P<wd>[1-7])",
    r"(?P<Y>\d{4})-(?P<yd>\d{3})",
]
FORMS = [
    *(re.compile(rf"{d}{_AT}{_T}{_Z}", re.I) for d in _D),
    re.compile(rf"(?P<Y>\d{{4}})(?P<m>\d{{2}})(?P<d>\d{{2}})t?(?P<H>\d{{2}})(?P<M>\d{{2}})(?P<S>\d{{2}})(?:\.(?P<f>\d+))?(?P<ap>(?!))?{_Z}", re.I),
    *(re.compile(rf"{_T}{_ON}{d}{_Z}", re.I) for d in _D),
    re.compile(rf"{_DAY}{_B}\s+(?P<d>\d{{1,2}})\s+{_T}{_Z}\s+(?P<Y>\d{{4}})", re.I),
]


@lru_cache(256)
def _zone(name: str | None) -> ZoneInfo | None:
    try:
        return ZoneInfo(name) if name else None
    except Exception:
        return None


@lru_cache(256)
def _region(name: str) -> ZoneInfo | None:
    return _zone("/".join("_".join(w.capitalize() for w in p.split("_")) for p in name.split("/"))) or _zone(name)


def _epoch(raw: str) -> int | None:
    """A bare number of seconds to nanoseconds since 1970 or 2001; only the reading within the allowed years counts."""
    whole, _, part = raw.partition(".")
    for scale in (1_000_000, 1_000, 1, 0):
        if scale:
            us = int(whole) * scale + (int((part + "000000")[:6]) * scale // 1_000_000 if part else 0)
        else:
            us = int(whole) // 1000
        for start in (0, APPLE_EPOCH_S * 1_000_000):
            if FIRST_US <= us + start < END_US:
                return us + start
    return None


def parse_instant(raw: str | None, zone: str | None, locale: str | None) -> int | None:
    """Microseconds since 1970-01-01 UTC, or None where ``raw`` denotes no instant.

    ``zone`` rules wall times; a wall time that occurs twice means the first, a skipped one is read with the offset
    before the change. ``locale`` ``en_US`` puts the month first in all-numeric dates. None, blank, unreadable and
    impossible values, and wall times without a known zone, give None.
    """
    if raw is None:
        return None
    raw = " ".join(raw.split())
    if not raw:
        return None
    if raw.isascii() and re.fullmatch(r"\d{8,19}(?:\.\d+)?", raw):
        return _epoch(raw)
    for form in FORMS:
        if m := form.fullmatch(raw):
            break
    else:
        return None
    g = m.groupdict()
    if g.get("b"):
        if not (month := _MONTH.get(g["b"].lower())):
            return None
        day = int(g["d"])
    elif g.get("w") or g.get("yd"):
        try:
            first = datetime.fromisocalendar(int(g["Y"]), int(g["w"]), int(g["wd"])) if g.get("w") else datetime(int(g["Y"]), 1, 1) + timedelta(days=int(g["yd"]) - 1)
        except ValueError:
            return None
        if g.get("yd") and first.year != int(g["Y"]):
            return None
        g["Y"], month, day = str(first.year), first.month, first.day
    elif g.get("n1"):
        month, day = (int(g["n1"]), int(g["n2"])) if locale == "en_US" else (int(g["n2"]), int(g["n1"]))
    else:
        month, day = int(g["m"]), int(g["d"])
    year, hour = int(g["Y"]) + (2000 if len(g["Y"]) == 2 else 0), int(g["H"])
    if g.get("ap"):
        if not 1 <= hour <= 12:
            return None
        hour = hour % 12 + 12 * (g["ap"][0] in "pP")
    try:
        wall = datetime(year, month, day, hour, int(g["M"]), int(g["S"] or 0), int((g["f"] or "0").ljust(6, "0")[:6]))
    except ValueError:
        return None
    if g["z"]:
        offset = timedelta()
    elif g["oh"]:
        offset = timedelta(hours=int(g["oh"]), minutes=int(g["om"] or 0)) * (-1 if g["sg"] == "-" else 1)
    elif g["reg"]:
        if not (tz := _region(g["reg"])):
            return None
        offset = wall.replace(tzinfo=tz).utcoffset()
    else:
        offset = _abbreviated(g["ab"], zone) if g["ab"] else None
        if offset is None:
            if g["ab"] and g["ab"].lower() not in ABBREVIATIONS or not (tz := _zone(zone)):
                return None
            offset = wall.replace(tzinfo=tz).utcoffset()
    return (wall - EPOCH - offset) // timedelta(microseconds=1)


@lru_cache(1024)
def _abbreviated(name: str, zone: str | None) -> timedelta | None:
    """The offset an abbreviation has in ``zone``; UTC anywhere; one of another zone only if ``zone`` is unknown."""
    low = name.lower()
    if low == "utc":
        return timedelta()
    if tz := _zone(zone):
        for month in (1, 7):
            at = datetime(2024, month, 1, tzinfo=tz)
            if at.tzname().lower() == low:
                return at.utcoffset()
    minutes, prefix = ABBREVIATIONS.get(low, (None, "-"))
    if minutes is not None and (not zone or zone.startswith(prefix) or low == "gmt"):
        return timedelta(minutes=minutes)
    return None


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        values = [parse_instant(*x) for x in zip(b["raw"], b["zone"], b["locale"])]
        yield b.assign(utc_us=pd.array(values, dtype="Int64"))


def parser_version() -> str:
    """A name that changes with this module."""
    return hashlib.md5(inspect.getsource(sys.modules[__name__]).encode()).hexdigest()[:12]


class InstantDictionary:
    """The table of distinct (raw, zone, locale) with its instant, kept at ``path`` and only ever added to.

    ``update`` takes mentions with nulls and repeats; it parses those values that the table lacks and appends them.
    An empty input changes nothing. Values that are no instant are kept with a null, so they aren't tried again. Two
    writers at once may append the same value; ``table`` gives it once.
    """

    SCHEMA = "raw string, zone string, locale string, utc_us bigint"
    KEY = ["raw", "zone", "locale"]

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or f"{shared_dir(spark)}/marlstone/instants-{parser_version()}"

    def table(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.SCHEMA).parquet(self.path).groupBy(*self.KEY).agg(F.max("utc_us").alias("utc_us"))
        except AnalysisException:
            return self.spark.createDataFrame([], self.SCHEMA)

    def update(self, mentions: DataFrame) -> "InstantDictionary":
        fresh = mentions.where(F.col("raw").isNotNull()).select("raw", F.coalesce("zone", F.lit("")).alias("zone"), F.coalesce("locale", F.lit("")).alias("locale")).distinct()
        fresh.join(self.table().select(*self.KEY), self.KEY, "left_anti").mapInPandas(_parsed, self.SCHEMA).write.mode("append").parquet(self.path)
        return self

    def resolve(self, mentions: DataFrame) -> DataFrame:
        """``mentions`` with ``utc_us`` (null where the value is no instant); all other columns stay.

        A raw string that fills a third of the rows meets one dictionary row; the adaptive planner splits its
        partition, since the dictionary side is unique.
        """
        keyed = mentions.withColumns({"zone": F.coalesce("zone", F.lit("")), "locale": F.coalesce("locale", F.lit(""))})
        return keyed.join(self.table(), self.KEY, "left")


def mention_in(text: Column) -> Column:
    """The first date with a time of day in ``text``, styled digits and look-alike letters folded; null if none."""
    # Without a clock or a basic stamp there is nothing to look for.
    return let(ascii_fold(text), lambda t: F.when(t.rlike(CLOCK), F.nullif(F.regexp_extract(t, MENTION, 0), F.lit(""))))


def instants(
    messages: DataFrame, backups: DataFrame, dictionary: str | None = None, id_col: str = "id", date_col: str = "date", text_col: str = "text", file_col: str = "fileid"
) -> DataFrame:
    """``(id, field, utc_us)``: every instant that ``date_col`` (unless already in normal form) and ``text_col`` state.

    ``backups`` gives ``fileid, tz, locale``; rows without a backup keep only values with a zone of their own. Null,
    blank and unreadable values give no row; repeated rows give repeated results; extra columns are ignored.
    ``dictionary``: where the table of parsed values is kept, else in the shared folder; a later call parses new values only.
    """
    spark = messages.sparkSession
    zones = require(backups, file_col, "tz", "locale").where(F.col("tz").isNotNull()).dropDuplicates([file_col])
    rows = require(messages, id_col, date_col, text_col, file_col).join(bounded_broadcast(zones), file_col, "left")
    of = lambda field, raw, keep: rows.select(F.col(id_col).alias("id"), F.lit(field).alias("field"), raw.alias("raw"), F.col("tz").alias("zone"), "locale").where(keep)
    dates = of("date", F.col(date_col), ~F.col(date_col).rlike(NORMAL_FORM) & (F.trim(date_col) != ""))
    texts = of("text", mention_in(F.col(text_col)), F.col("raw").isNotNull())
    # The pattern runs over each text once; dictionary and join read what it found.
    mentions = written(dates.unionByName(texts), "mentions")
    book = InstantDictionary(spark, dictionary).update(mentions)
    return book.resolve(mentions).where("utc_us IS NOT NULL").select("id", "field", "utc_us")
