"""Timestamps in many shapes, and local calendar buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Numbers up to this are seconds since 1970, larger ones milliseconds.
SECONDS_UP_TO = 1e10


#: Fixed value: texts that are a number of seconds or milliseconds.
EPOCH_TEXT = r"^[0-9]{9,13}(\.[0-9]+)?$"


def epoch_timestamp(number: Column) -> Column:
    """Any number of seconds since 1970, or of milliseconds where it is over ``SECONDS_UP_TO``."""
    n = number.cast("double")
    return F.timestamp_millis(F.round(F.when(n <= SECONDS_UP_TO, n * 1000).otherwise(n)).cast("long"))


def parse_timestamp(text: Column) -> Column:
    """RFC 3339, zone-less (UTC) and date-only texts, and epochs of 9 to 13 digits; anything else is null. Numbers go through ``epoch_timestamp``."""
    t = F.trim(text.cast("string"))
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:?\d{2})?)?$"), F.try_to_timestamp(t))
    return F.coalesce(iso, epoch_timestamp(F.when(t.rlike(EPOCH_TEXT), t)))


def canonical(ts: Column) -> Column:
    """Fixed-width UTC text with milliseconds, so that text order is time order."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def local_day(ts: Column, tz: str = "UTC") -> Column:
    return F.to_date(F.from_utc_timestamp(ts, tz))


def local_week(ts: Column, tz: str = "UTC") -> Column:
    """The Monday of the local week."""
    return F.to_date(F.date_trunc("week", F.from_utc_timestamp(ts, tz)))


def local_month(ts: Column, tz: str = "UTC") -> Column:
    return F.date_format(F.from_utc_timestamp(ts, tz), "yyyy-MM")
