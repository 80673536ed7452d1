"""Exchange clock arithmetic on integer nanoseconds and microseconds.

Nothing here depends on the session time zone: instants stay ``long`` and local
wall clock is microseconds since 1970-01-01 of the local calendar.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NEW_YORK = "America/New_York"
DAY_US, MINUTE_US = 86_400_000_000, 60_000_000


def _div(a: Column, b: int) -> Column:
    """Floor division of longs (plain ``div`` truncates towards zero)."""
    return ((a - F.pmod(a, F.lit(b))) / F.lit(b)).cast("long")


def epoch_us(ts: Column) -> Column:
    """Microseconds of a timestamp without zone, read as UTC."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def local_us(ns: Column, zone: str = NEW_YORK) -> Column:
    """Local wall clock, in microseconds, of a UTC nanosecond epoch; follows DST."""
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(_div(ns, 1000)), zone))


def local_to_ns(us: Column, zone: str = NEW_YORK) -> Column:
    """UTC nanosecond epoch of a local wall clock in microseconds."""
    return F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(us), zone)) * 1000


def date_of(us: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), _div(us, DAY_US).cast("int"))


def minute_of(us: Column) -> Column:
    """Minute of the day, 0-1439."""
    return _div(F.pmod(us, F.lit(DAY_US)), MINUTE_US)


def us_of(day: Column, minute: Column) -> Column:
    """Local microseconds of a date and a minute of the day."""
    return F.unix_date(day).cast("long") * DAY_US + minute.cast("long") * MINUTE_US
