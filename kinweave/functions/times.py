"""Times as exports write them, to UTC timestamps; what can't be read is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXCEL_EPOCH_DAYS, TWEET_EPOCH_MS = 25569, 1288834974657


def from_iso(text: Column) -> Column:
    """ISO 8601; an offset is applied, none means UTC."""
    zoned = text.rlike(r"(?i)(Z|[+-]\d{2}:?\d{2})$")
    # a zoned text becomes an instant, then its UTC wall time
    return F.when(zoned, F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.try_to_timestamp(text).cast("timestamp_ntz"))).otherwise(text.try_cast("timestamp_ntz"))


def from_seconds(value: Column) -> Column:
    return _from_micros(value.try_cast("double") * 1_000_000)


def from_millis(value: Column) -> Column:
    return _from_micros(value.try_cast("double") * 1_000)


def _from_micros(value: Column) -> Column:
    return F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'") + F.make_dt_interval(secs=F.round(value / 1_000_000, 6).cast("decimal(18,6)"))


def from_excel(value: Column) -> Column:
    """Days since 1899-12-30."""
    return from_seconds(F.round((value.try_cast("double") - EXCEL_EPOCH_DAYS) * 86400, 3))


def from_snowflake(value: Column) -> Column:
    """The time in a post's id."""
    return from_millis(F.shiftright(value.try_cast("bigint"), 22) + TWEET_EPOCH_MS)


def from_slashes(text: Column, day_first: bool) -> Column:
    """1/2/2024 or 1.2.24, with a time after it or not."""
    part = lambda i: F.regexp_extract(text, r"^\s*(\d{1,4})[/.-](\d{1,2})[/.-](\d{2,4})(?:[ ,T]+(\d{1,2}):(\d{2})(?::(\d{2}))?\s*([AaPp])?)?", i)
    a, b, c = part(1).try_cast("int"), part(2).try_cast("int"), part(3).try_cast("int")
    year = F.when(c < 100, c + 2000).otherwise(c)
    day, month = (a, b) if day_first else (b, a)
    half, hour = F.lower(part(7)), F.coalesce(part(4).try_cast("int"), F.lit(0))
    hour = F.when(half == "p", hour % 12 + 12).when(half == "a", hour % 12).otherwise(hour)
    return F.try_make_timestamp_ntz(year, month, day, hour, F.coalesce(part(5).try_cast("int"), F.lit(0)), F.coalesce(part(6).try_cast("int"), F.lit(0)))


def from_twitter(text: Column) -> Column:
    """Wed Oct 10 20:19:24 +0000 2018"""
    bare = F.regexp_replace(text, r"^\w{3} (\w{3}) (\d{1,2}) (\d\d:\d\d:\d\d) ([+-]\d{4}) (\d{4})$", "$5 $1 $2 $3")
    return F.try_to_timestamp(bare, F.lit("yyyy MMM d HH:mm:ss")).cast("timestamp_ntz")


def in_zone(local: Column, zone: str) -> Column:
    """Wall time of a zone to UTC."""
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), local)


FORMATS = {"iso": from_iso, "mdy": lambda c: from_slashes(c, False), "dmy": lambda c: from_slashes(c, True), "seconds": from_seconds, "millis": from_millis, "excel": from_excel}


def detect(table: DataFrame, column: str) -> str | None:
    """Which format reads a column: all values of one kind; slashed dates are day first where a first part exceeds 12, month first where a second does."""
    text = F.trim(F.col(column).cast("string"))
    number = text.try_cast("double")
    part = lambda i: F.regexp_extract(text, r"^(\d{1,2})[/.-](\d{1,2})[/.-]\d{2,4}", i).try_cast("int")
    row = table.where(F.length(text) > 0).agg(
        F.count("*").alias("n"), F.count(number).alias("numbers"), F.min(number).alias("least"), F.max(number).alias("most"),
        F.count(part(1)).alias("slashed"), F.max(part(1)).alias("first"), F.max(part(2)).alias("second"), F.count_if(text.rlike(r"^\d{4}-\d{2}-\d{2}")).alias("iso"),
    ).collect()[0]
    if not row["n"]:
        return None
    if row["numbers"] == row["n"]:
        return "millis" if row["most"] >= 1e11 else "seconds" if row["most"] >= 1e8 else "excel" if 1 <= row["least"] and row["most"] < 1e5 else None
    if row["iso"] == row["n"]:
        return "iso"
    if row["slashed"] == row["n"]:
        return "dmy" if row["first"] > 12 else "mdy"
    return None


def to_time(value: Column, kind: str) -> Column:
    return FORMATS[kind](value)
