"""First login per user and the 24-hour first-time rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from eventlens.functions.identity import FIRST_TIME, RETURNING
from eventlens.functions.timeutil import MICROS_PER_DAY


def first_login(events: DataFrame, login_event: str = "login_success",
                user_col: str = "user_id", ts_col: str = "event_timestamp") -> DataFrame:
    """``ROW_NUMBER() OVER (PARTITION BY user ORDER BY ts) = 1`` keeping only the
    timestamp is the per-user minimum: an aggregation, so a hot user collapses
    map-side instead of being sorted in one task.  NULL users are dropped here:
    they can never match the equi-join that consumes this table."""
    return (events.filter((F.col("event_name") == login_event) & F.col(user_col).isNotNull())
            .groupBy(user_col).agg(F.min(ts_col).alias("first_login_ts")))


def first_time_label(ts: str | Column, first_login_ts: str | Column = "first_login_ts") -> Column:
    """FIRST-TIME when first_login <= ts <= first_login + 24 h, else RETURNING."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    fl = F.col(first_login_ts) if isinstance(first_login_ts, str) else first_login_ts
    inside = fl.isNotNull() & (ts >= fl) & (ts <= fl + F.lit(MICROS_PER_DAY))
    return F.when(inside, F.lit(FIRST_TIME)).otherwise(F.lit(RETURNING))
