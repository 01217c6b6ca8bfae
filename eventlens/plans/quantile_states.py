"""Quantiles that merge: a KLL sketch of the time to the first game per day of
the session start, user type and OS.

The source's approximate quantiles need every session of the range.  A sketch
per day merges with those of other days, so a range costs one small row per day
and group.  Its size is bounded by ``k`` alone.  With probability 0.99 a
quantile's rank is off by at most ``rank_error(k)`` of the sessions, however
many there are; up to about k sessions per group it is the nearest rank itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from eventlens.functions.identity import user_type_by_session_number
from eventlens.functions.timeutil import secs_between, utc_date
from eventlens.plans.kpi import baseline_sessions

K = 4096
GROUP = ["user_type", "operating_system"]


def rank_error(k: int = K) -> float:
    """Bound on the rank error of one quantile at 99 % confidence; the constants
    are the published fit for this kind of sketch (fixed values)."""
    return 2.296 / k ** 0.9021


def time_to_game_sketches(events: DataFrame, date_from: str, date_to: str, locale: str = "tr", section: str = "casino",
                          k: int = K) -> DataFrame:
    """(activity_date, user_type, operating_system, lobby_sessions, sketch) of
    the lobby sessions of the shards, from events or daily session states.
    Sessions without a game count, but not in the sketch."""
    seconds = secs_between("first_gameplay_ts", "lobby_first_ts")
    sess = baseline_sessions(events, date_from, date_to, locale, section)
    return sess.groupBy(utc_date("lobby_first_ts").alias("activity_date"), user_type_by_session_number().alias("user_type"),
                        "operating_system").agg(F.count(F.lit(1)).alias("lobby_sessions"),
                                                F.count(seconds).alias("with_game"),
                                                F.kll_sketch_agg_double(seconds, k).alias("sketch"))


def time_to_game_quantiles(sketches: DataFrame, day_from: str, day_to: str, k: int = K) -> DataFrame:
    """Median and third quartile of the time to the first game (Q07) over the
    days of session start, by merging sketches."""
    days = sketches.filter(F.col("activity_date").between(F.lit(day_from).cast("date"), F.lit(day_to).cast("date")))
    merged = days.groupBy(*GROUP).agg(F.sum("lobby_sessions").alias("lobby_sessions"), F.sum("with_game").alias("with_game"),
                                      F.kll_merge_agg_double("sketch", k).alias("sketch"))

    def quantile(p: float):
        return F.when(F.col("with_game") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(p)))
    out = merged.select(*GROUP, "lobby_sessions", quantile(0.5).alias("median_time_to_first_gameplay_sec"),
                        quantile(0.75).alias("p75_time_to_first_gameplay_sec"))
    return out.orderBy(F.desc("lobby_sessions"), *GROUP)
