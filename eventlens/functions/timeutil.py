"""Time helpers on INT64 microseconds since the epoch (UTC).

Everything is computed arithmetically from microseconds so that results do
not depend on the session time zone of the caller.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MICROS_PER_SECOND = 1_000_000
MICROS_PER_DAY = 86_400 * MICROS_PER_SECOND


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros_of_ntz(ts: str | Column) -> Column:
    """Microseconds since the epoch of a TIMESTAMP_NTZ read as UTC wall time."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), _col(ts))


def utc_date(micros: str | Column) -> Column:
    """``DATE(TIMESTAMP_MICROS(x))`` in UTC."""
    return F.date_from_unix_date(F.floor(_col(micros) / F.lit(MICROS_PER_DAY)).cast("int"))


def week_monday(d: str | Column) -> Column:
    """``DATE_TRUNC(d, WEEK(MONDAY))``."""
    return F.date_trunc("week", _col(d)).cast("date")


def week_sunday(d: str | Column) -> Column:
    """``TIMESTAMP_TRUNC(d, WEEK)``: weeks start on Sunday."""
    d = _col(d)
    return F.date_sub(d, F.dayofweek(d) - 1)


def week_num_sunday(d: str | Column) -> Column:
    """``EXTRACT(WEEK FROM d)``: Sunday weeks 0..53, days before the first
    Sunday of the year are week 0 (C ``%U``).  ``weekofyear`` is ISO and differs."""
    d = _col(d)
    return F.floor((F.dayofyear(d) + F.lit(7) - F.dayofweek(d)) / F.lit(7)).cast("long")


def secs_between(later: str | Column, earlier: str | Column) -> Column:
    """``SAFE_DIVIDE(later - earlier, 1000000)`` as DOUBLE, NULL when an input is NULL."""
    return F.try_divide((_col(later) - _col(earlier)).cast("double"), F.lit(float(MICROS_PER_SECOND)))


def date_from_shard(event_date: str | Column) -> Column:
    """``PARSE_DATE('%Y%m%d', event_date)``."""
    return F.to_date(_col(event_date), "yyyyMMdd")
