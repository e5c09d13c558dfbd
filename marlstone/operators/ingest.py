"""From raw message rows to exported messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.text import strip
from marlstone.session import bounded_broadcast, require

APPLE_EPOCH_US = 978_307_200_000_000


def apple_time(ns: Column) -> Column:
    """Nanoseconds since 2001 as a timestamp without zone, rounded to microseconds."""
    us = F.call_function("div", ns + 500, F.lit(1000).cast("long"))
    return F.timestamp_micros(F.lit(APPLE_EPOCH_US) + us).cast("timestamp_ntz")


def epoch_seconds(text: Column) -> Column:
    """Seconds since 1970, with a fraction or not, up to the year 9999; null for any other text."""
    number = F.when(text.rlike(r"^[0-9]{1,12}(?:\.[0-9]+)?$"), text.try_cast("double"))
    return F.timestamp_seconds(F.when(number < 253_402_300_800, number)).cast("timestamp_ntz")


def iso_time(text: Column) -> Column:
    """A date with a time of day to the microsecond at most, without zone; null for any other text and impossible ones."""
    return F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]{1,6})?$"), text.try_cast("timestamp_ntz"))


def attributed_body(blob: Column) -> Column:
    """The text of ``attributed_bytes``; bytes that are no UTF-8 become replacement characters."""
    return F.make_valid_utf8(attributed_bytes(blob).cast("string"))


def attributed_bytes(blob: Column) -> Column:
    """The bytes of the text inside an archived attributed string; null where the markers or a length are missing.

    One byte of length below 0x80, or 0x81 with two, or 0x82 with four bytes, least first. A blob shorter than its length
    gives what is there; one that ends before its length gives null.
    """
    s = F.decode(blob, "ISO-8859-1")
    mark = F.instr(s, "NSString")
    plus = F.call_function("locate", F.lit("\x01+"), s, mark + 8)
    at = plus + 2
    byte = lambda k: F.conv(F.hex(F.substr(blob, at + k, F.lit(1))), 16, 10).try_cast("long")
    first = byte(0)
    size = F.when(first < 0x80, first).when(first == 0x81, byte(1) + byte(2) * 256).when(first == 0x82, byte(1) + byte(2) * 256 + byte(3) * 65536 + byte(4) * 16777216)
    skip = F.when(first < 0x80, 1).when(first == 0x81, 3).otherwise(5)
    body = F.substr(blob, (at + skip).cast("int"), size.cast("int"))
    return F.when((mark > 0) & (plus > 0) & size.isNotNull(), body)


def body(text: Column, blob: Column) -> Column:
    """The text unless blank, else what the blob holds; null if that is nothing either."""
    decoded = attributed_body(blob)
    return F.when(strip(text) != "", text).otherwise(F.when(strip(decoded) != "", decoded))


def exported(messages: DataFrame, handles: DataFrame) -> DataFrame:
    """``(id, date, sender, text, is_from_me, service)`` of messages with a date and a recoverable body.

    Messages without a handle keep an empty sender, own ones are from ``me``; repeated rows stay repeated; handles must
    be unique and are broadcast only if few.
    """
    m = require(messages, "rowid", "date", "handle_id", "text", "attributedbody", "is_from_me", "service").where("date > 0")
    h = require(handles, "rowid", "id").select(F.col("rowid").alias("handle_id"), F.col("id").alias("handle"))
    joined = m.join(bounded_broadcast(h), "handle_id", "left")
    out = joined.select(
        F.col("rowid").alias("id"),
        apple_time(F.col("date")).alias("date"),
        F.coalesce(F.when(F.col("is_from_me") == 1, "me").otherwise(F.col("handle")), F.lit("")).alias("sender"),
        body(F.col("text"), F.col("attributedbody")).alias("text"),
        F.col("is_from_me").cast("boolean").alias("is_from_me"),
        F.coalesce("service", F.lit("")).alias("service"),
    )
    return out.where("text IS NOT NULL")


def provenance(messages: DataFrame) -> DataFrame:
    """How many messages with a date have their body in the text, in the blob, or nowhere."""
    m = messages.where("date > 0").select((F.coalesce(strip(F.col("text")), F.lit("")) != "").alias("plain"), attributed_body(F.col("attributedbody")).alias("decoded"))
    blob = ~F.col("plain") & F.coalesce(strip(F.col("decoded")) != "", F.lit(False))
    return m.agg(F.count("*").alias("total"), F.count_if("plain").alias("from_text"), F.count_if(blob).alias("from_blob"), F.count_if(~F.col("plain") & ~blob).alias("no_content"))


def message_databases(files: DataFrame) -> DataFrame:
    """The message databases of a backup, upper or lower case, with the path below the backup's folder."""
    return files.where(F.col("relativepath").ilike("%sms.db")).select("fileid", "relativepath", F.concat(F.substring("fileid", 1, 2), F.lit("/"), F.col("fileid")).alias("stored_at"))
