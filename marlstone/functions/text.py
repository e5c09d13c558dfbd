"""Text expressions: everything native, nothing per row in Python."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Characters that XML 1.0 forbids.
ILLEGAL_XML = r"[^\x09\x0A\x0D\x20-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]"


def regex(pattern: str, dotall: bool = False) -> str:
    """Case-insensitive, Unicode classes and boundaries, only a line feed ends a line; ``dotall``: nothing does."""
    return f"(?iUd{'s' if dotall else ''}){pattern}"


def matches(text: Column, pattern: str, dotall: bool = False) -> Column:
    """Whether ``pattern`` occurs; false, never null, for a null text."""
    return F.coalesce(text.rlike(regex(pattern, dotall)), F.lit(False))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` names it; keeps generated code small."""
    return F.element_at(F.transform(F.array(value), use), 1)


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", " ")


def truncate(text: Column, n: int, mark: str = "…") -> Column:
    """The first ``n`` characters, with ``mark`` after them if there were more."""
    return F.when(F.char_length(text) > n, F.concat(F.substring(text, 1, n), F.lit(mark))).otherwise(text)


def one_line(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit(" "))


def prefix(text: Column, n: int = 80) -> Column:
    return F.substring(text, 1, n)


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def sanitised(df: DataFrame) -> DataFrame:
    """Every string column without characters that XML 1.0 forbids, in one projection."""
    return df.select(*(F.regexp_replace(F.col(f"`{f.name}`"), ILLEGAL_XML, "").alias(f.name) if isinstance(f.dataType, StringType) else F.col(f"`{f.name}`") for f in df.schema))


def first_match(text: Column, rules: list[tuple[str, str]], other: str, dotall: bool = False) -> Column:
    """The name of the first rule whose pattern occurs in ``text``, else ``other``."""
    out = None
    for name, pattern in rules:
        hit = matches(text, pattern, dotall)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(other)


def to_bool(text: Column) -> Column:
    return F.coalesce(F.lower(strip(text)).isin("1", "true", "yes", "on"), F.lit(False))


def maybe_string(text: Column) -> Column:
    """Null for blank texts and the words that mean nothing."""
    t = strip(text)
    return F.when((t != "") & ~F.lower(t).isin("none", "null"), t)
