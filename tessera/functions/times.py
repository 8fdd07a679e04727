"""Column functions over time. Durations are whole units and truncate towards zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(later: Column, earlier: Column) -> Column:
    """Microseconds from one time to another, for times without a zone."""
    return F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))


def _whole(later: Column, earlier: Column, unit: int) -> Column:
    m = micros(later, earlier)
    return (F.sign(m) * F.floor(F.abs(m) / unit)).cast("bigint")


def whole_seconds(later: Column, earlier: Column) -> Column:
    return _whole(later, earlier, 1_000_000)


def whole_minutes(later: Column, earlier: Column) -> Column:
    return _whole(later, earlier, 60_000_000)


def whole_hours(later: Column, earlier: Column) -> Column:
    return _whole(later, earlier, 3_600_000_000)


def day_name(t: Column) -> Column:
    return F.date_format(t, "EEEE")


def parsed_date(text: Column, pattern: str = "MM/dd/yyyy") -> Column:
    """A date, or null where the text is none."""
    return F.try_to_timestamp(text, F.lit(pattern)).cast("date")


def minutes_of_day(text: Column) -> Column:
    """``H:mm`` or ``HH:mm`` as minutes from midnight; null where the text is no time of day."""
    h, m = F.regexp_extract(text, r"^\s*(\d{1,2}):(\d{2})\s*$", 1).try_cast("int"), F.regexp_extract(text, r"^\s*(\d{1,2}):(\d{2})\s*$", 2).try_cast("int")
    return F.when((h < 24) & (m < 60), h * 60 + m)


def parsed_timestamp(text: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """A time without zone, or null where the text is none."""
    return F.try_to_timestamp(text, F.lit(pattern)).cast("timestamp_ntz")
