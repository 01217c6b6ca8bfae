"""User cohort: NEW or RETURNING by first appearance against a cutoff."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from eventlens.functions.identity import NEW_USER, RETURNING_USER


def cutoff_micros(day: str) -> int:
    """Microseconds of ``day`` (yyyy-MM-dd) at 00:00 UTC."""
    d = dt.datetime.strptime(day, "%Y-%m-%d").replace(tzinfo=dt.timezone.utc)
    return int(d.timestamp()) * 1_000_000


def user_cohort(events: DataFrame, cutoff: str, user_col: str = "user_id",
                ts_col: str = "event_timestamp", keep_first: bool = False) -> DataFrame:
    """One row per user (NULL user included as one group): ``user_type``.

    RETURNING_USER when the first event in the scanned range is before
    ``cutoff`` 00:00 UTC, else NEW_USER.  Partial aggregation makes a hot user
    cheap.
    """
    first = events.groupBy(user_col).agg(F.min(ts_col).alias("first_event_ts"))
    label = F.when(F.col("first_event_ts") < F.lit(cutoff_micros(cutoff)), F.lit(RETURNING_USER)) \
        .otherwise(F.lit(NEW_USER))
    cols = [F.col(user_col), label.alias("user_type")]
    if keep_first:
        cols.append(F.col("first_event_ts"))
    return first.select(*cols)
