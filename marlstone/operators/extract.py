"""Typed records out of message texts, and the categories of messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions import patterns as P
from marlstone.functions.text import first_match, let, matches, regex, strip

RECORD = "struct<amount:double,counterparty:string,date:string,type:string,account:string>"


def amount(text: Column) -> Column:
    """A number without its thousands separators; null where it is none."""
    return F.replace(text, F.lit(","), F.lit("")).try_cast("double")


def _month(name: Column) -> Column:
    months = F.create_map(*(F.lit(x) for k, m in enumerate(P.MONTHS) for x in (m, f"{k + 1:02d}")))
    return F.try_element_at(months, F.lower(name))


def date(text: Column) -> Column:
    """Any of the date shapes as day-month-year; days and months are not validated; other texts stay as they are.

    An unknown month name leaves the text as it is.
    """
    return let(F.regexp_replace(strip(text), r"\.+$", ""), _day_month_year)


def _day_month_year(raw: Column) -> Column:
    g = lambda p, k: F.regexp_extract(raw, f"(?U){p}", k)
    day = lambda p, k: F.lpad(g(p, k), 2, "0")
    hit = lambda p: raw.rlike(f"(?U){p}")
    iso, slash, named, dashed, joined, short = P.DATE_SHAPES.values()
    year = F.when(F.length(g(dashed, 3)) == 4, g(dashed, 3)).otherwise(F.concat(F.lit("20"), g(dashed, 3)))
    out = (
        F.when(hit(iso), F.concat_ws("-", g(iso, 3), g(iso, 2), g(iso, 1)))
        .when(hit(slash), F.concat(day(slash, 1), F.lit("-"), g(slash, 2), F.lit("-20"), g(slash, 3)))
        .when(hit(named), F.concat(day(named, 1), F.lit("-"), _month(g(named, 2)), F.lit("-"), g(named, 3)))
        .when(hit(dashed), F.concat(day(dashed, 1), F.lit("-"), _month(g(dashed, 2)), F.lit("-"), year))
        .when(hit(joined), F.concat(day(joined, 1), F.lit("-"), _month(g(joined, 2)), F.lit("-20"), g(joined, 3)))
        .when(hit(short), F.concat(g(short, 1), F.lit("-"), g(short, 2), F.lit("-20"), g(short, 3)))
    )
    return F.coalesce(out, raw)


def which_extractor(text: Column) -> Column:
    """The name of the first extractor that matches, or null."""
    out = None
    for name, pattern, *_ in P.EXTRACTORS:
        hit = matches(text, pattern, True)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def record_of(text: Column, name: Column) -> Column:
    """The record that the extractor called ``name`` reads; null for a null name or a text that it doesn't match.

    Each pattern is a literal in its own branch, so it is compiled once, not for each row.
    """
    read = None
    for n, pattern, kind, groups in P.EXTRACTORS:
        p = regex(pattern, dotall=True)
        parts = F.struct(F.lit(n).alias("name"), F.lit(kind).alias("kind"), F.lit(groups[2] == 0).alias("nobody"), *(F.regexp_extract(text, p, g).alias(f"g{k}") for k, g in enumerate(groups)))
        hit = (name == n) & text.rlike(p)
        read = F.when(hit, parts) if read is None else read.when(hit, parts)
    return let(read, lambda r: F.when(r.isNotNull(), _record(r)))


def _record(r: Column) -> Column:
    found = strip(r["g2"])
    who = (
        F.when(r["nobody"], F.lit(None).cast("string"))
        .when(r["name"] == "hdfc_credit_alert", F.regexp_replace(F.regexp_replace(found, r"\)+$", ""), r"(?iUds)\s*\(UPI.*", ""))
        .when(r["name"] == "hdfc_neft_deposit", strip(F.try_element_at(F.split(r["g2"], "-"), F.lit(2))))
        .when(r["name"] == "icici_debited", F.regexp_replace(found, r"\.+$", ""))
        .otherwise(found)
    )
    return F.struct(amount(r["g0"]).alias("amount"), who.alias("counterparty"), date(r["g3"]).alias("date"), r["kind"].alias("type"), strip(r["g1"]).alias("account"))


def extractor(text: Column, name: str) -> Column:
    """The record that the named extractor reads, or null."""
    return record_of(text, F.lit(name))


def transaction(text: Column) -> Column:
    """The record of the first extractor that matches, or null."""
    return record_of(text, which_extractor(text))


def transaction_category(text: Column) -> Column:
    return first_match(text, P.TRANSACTION_CATEGORIES, P.OTHER, dotall=True)


def other_category(text: Column) -> Column:
    return first_match(text, P.OTHER_CATEGORIES, P.OTHER)


def false_positive(text: Column) -> Column:
    return matches(text, P.FALSE_POSITIVE)
