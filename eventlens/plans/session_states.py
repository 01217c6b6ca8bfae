"""Mergeable daily session states: the lobby KPIs (Q07, Q09, Q11, Q12, Q13, X3)
without reading old shards again.

``write_session_states`` reduces a shard to one row per (user, session, OS) of
counts, minima and maxima, a fraction of its events, and stores it by day; a day
that is written again is replaced.  All of these values add up: a session that
goes over midnight has a row in both days, and ``sessions_from_states`` merges
the rows of the days asked for, which equals the rollup over all their events.
The KPI analyses take such a table in place of the events.

A state holds two lobbies, the root page of one path and the root page of a
section in any locale; a table built for other paths than an analysis asks for
is refused when it is read.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from eventlens.functions.predicates import lobby_root, lobby_root_any_locale, mobile_or_tablet
from eventlens.plans.common import BANNER, GAMEPLAY, PAGE_VIEW, PROMO_AREA, flag, scan
from eventlens.sources.events import shard_range

SEARCH = "search_window_initiated"
SCROLL = "scroll"
DEP_WINDOW = "deposit_window_opened"
DEP_INIT = "deposit_initiated"
DEP_OK = "deposit_success"
#: Events whose absence makes the daily flags NULL.
DAILY_EVENTS = (GAMEPLAY, BANNER, DEP_OK, DEP_INIT, DEP_WINDOW)
#: What the KPIs look for in a session: name -> event.  ``promo`` is a banner
#: event of the promotion area.
SIGNALS = {"gameplay": GAMEPLAY, "promo": BANNER, "search": SEARCH, "scroll": SCROLL, "deposit_window": DEP_WINDOW,
           "deposit_initiated": DEP_INIT, "deposit_success": DEP_OK}
LOBBIES = ("root", "any")
#: Rows of a state file are dealt by day; the column marks a table as states.
MARK = "state_lobbies"


def signal(name: str) -> Column:
    """Condition on an event; three-valued for ``promo``, as in the source."""
    cond = F.col("event_name") == SIGNALS[name]
    return cond & (F.col("navigation_selection") == PROMO_AREA) if name == "promo" else cond


def lobby_row(path: Column) -> Column:
    return (F.col("event_name") == PAGE_VIEW) & mobile_or_tablet("device_category") & path


def _lobbies(lobby_path: str, locale: str, section: str) -> Column:
    return F.lit(f"{lobby_path}\n{locale}\n{section}")


def session_states(events: DataFrame, lobby_path: str = "/tr/casino", locale: str = "tr", section: str = "casino",
                   user_col: str = "user_id") -> DataFrame:
    """One row per (shard date, user, session, OS), in one hash aggregation with
    map-side combine: no string is aggregated, the OS is a key."""
    used = events.filter(F.col("event_name").isin(PAGE_VIEW, *SIGNALS.values()))
    ev = scan(used, "00000000", "99999999", ["ga_session_id", "ga_session_number", "page_location", "navigation_selection"],
              [user_col, "event_name", "event_timestamp", "device_category", "operating_system", "event_date"])
    ts = F.col("event_timestamp")
    aggs = []
    for name, path in zip(LOBBIES, (lobby_root("page_location", lobby_path), lobby_root_any_locale("page_location", locale, section))):
        here = lobby_row(path)
        aggs += [F.count_if(here).alias(f"{name}_rows"), F.min(F.when(here, ts)).alias(f"{name}_first"),
                 F.max(F.when(here, F.col("ga_session_number"))).alias(f"{name}_number")]
    for name in SIGNALS:
        aggs += [F.count_if(signal(name)).alias(f"{name}_n"), F.min(F.when(signal(name), ts)).alias(f"{name}_first")]
    daily = F.col("event_name").isin(*DAILY_EVENTS)
    aggs += [F.count_if(daily).alias("daily_n"), F.count_if(daily & signal("promo").isNotNull()).alias("promo_known_n")]
    return ev.groupBy("event_date", user_col, "session_id", "operating_system").agg(*aggs).withColumn(
        MARK, _lobbies(lobby_path, locale, section))


def write_session_states(events: DataFrame, path: str, **options) -> None:
    """States of the days in ``events``, which replace those days and leave
    others alone: one call per new shard."""
    (session_states(events, **options).hint("rebalance", "event_date").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("event_date").parquet(path))


def read_session_states(spark: SparkSession, path: str, user_col: str = "user_id") -> DataFrame:
    from pyspark.sql.types import LongType, StringType, StructField, StructType
    longs = [f"{n}_{c}" for n in LOBBIES for c in ("rows", "first", "number")]
    longs += [f"{n}_{c}" for n in SIGNALS for c in ("n", "first")] + ["daily_n", "promo_known_n"]
    schema = StructType([StructField(user_col, StringType()), StructField("session_id", LongType()),
                         StructField("operating_system", StringType()), *[StructField(c, LongType()) for c in longs],
                         StructField(MARK, StringType()), StructField("event_date", StringType())])
    return spark.read.schema(schema).option("basePath", path).parquet(path)


def is_states(table: DataFrame) -> bool:
    return MARK in table.columns


def sessions_from_states(states: DataFrame, date_from: str, date_to: str, lobby: str, metrics: Mapping[str, tuple[str, str]],
                         user_col: str = "user_id", lobby_path: str | None = None, locale: str | None = None,
                         section: str | None = None) -> DataFrame:
    """The lobby sessions of the days, as ``lobby_session_rollup`` gives them.

    ``lobby``    root or any
    ``metrics``  name -> (kind, signal): first, count, has, or daily (three-valued,
                 NULL when the session has none of the daily events)
    """
    if user_col not in states.columns:
        raise ValueError(f"these states are not kept by {user_col}")
    asked = {0: lobby_path, 1: locale, 2: section}
    built = F.split(MARK, "\n")
    wrong = F.lit(False)
    for place, value in asked.items():
        if value is not None:
            wrong = wrong | (built[place] != value)
    refuse = F.when(wrong, F.raise_error(F.concat(F.lit("these states were built for another lobby: "), F.col(MARK))).cast("boolean"))
    days = shard_range(states, date_from, date_to).filter(F.coalesce(refuse, F.lit(True)))
    wanted = {s for _, s in metrics.values()}
    aggs = [F.sum(f"{lobby}_rows").alias("_rows"), F.min(f"{lobby}_first").alias("lobby_first_ts"),
            F.min(F.when(F.col(f"{lobby}_rows") > 0, F.col("operating_system"))).alias("operating_system"),
            F.max(f"{lobby}_number").alias("ga_session_number"),
            *[F.sum(c).alias(c) for c in ("daily_n", "promo_known_n")]]
    for name in sorted(wanted):
        aggs += [F.sum(f"{name}_n").alias(f"{name}_n"), F.min(f"{name}_first").alias(f"{name}_first")]
    rolled = days.groupBy(user_col, "session_id").agg(*aggs).filter(F.col("_rows") > 0)
    keyed = F.col(user_col).isNotNull() & F.col("session_id").isNotNull()

    def value(kind: str, name: str) -> Column:
        n, known = F.col(f"{name}_n"), F.col("promo_known_n" if name == "promo" else "daily_n")
        if kind == "first":
            return F.when(keyed, F.col(f"{name}_first"))
        if kind == "count":
            return F.when(keyed, n).otherwise(F.lit(0).cast("long"))
        if kind == "has":
            return flag(keyed & (n > 0))
        return F.when(keyed & (n > 0), F.lit(True)).when(keyed & (known > 0), F.lit(False))
    return rolled.select(user_col, "session_id", "lobby_first_ts", "operating_system", "ga_session_number",
                         *[value(kind, s).alias(name) for name, (kind, s) in metrics.items()])
