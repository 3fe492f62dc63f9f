"""Timetable clock times and instants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MOST_HOURS = 596_522  # more would not fit the seconds' type
_CLOCK = r"\A[0-9]+:[0-5]?[0-9]:[0-5]?[0-9]\z"


def clock_seconds(text: Column) -> Column:
    """Seconds since the start of the service day; `25:10:00` is valid, anything else is null."""
    clean = F.trim(text)
    part = F.split(clean, ":")
    hours, minutes, seconds = (F.get(part, F.lit(i)).try_cast("int") for i in range(3))
    return F.when(clean.rlike(_CLOCK) & (hours <= _MOST_HOURS), hours * 3600 + minutes * 60 + seconds)


def rfc3339(instant: Column) -> Column:
    """An instant as UTC text with a numeric offset, whatever the session time zone."""
    utc = F.to_utc_timestamp(instant, F.current_timezone())
    fraction = F.date_format(utc, "SSSSSS")
    seconds = F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss")
    tail = F.when(fraction == "000000", F.lit("")).otherwise(F.concat(F.lit("."), fraction))
    return F.concat(seconds, tail, F.lit("+00:00"))


def feed_instant(posix: Column, fallback: Column) -> Column:
    """Header time as a timestamp; a header without one takes the fallback of the cycle."""
    return F.coalesce(F.timestamp_seconds(posix), fallback)
