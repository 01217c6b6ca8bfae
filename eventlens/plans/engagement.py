"""Login-based engagement analyses (Q19, Q20).

First-time vs returning is the 24-hour rule against the first login in the
scanned range.  The per-user first-login table is an aggregate; it is joined
to event- or session-level rows; NULL users and frequent users are spread over
many tasks (``operators.joins``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from eventlens.functions.predicates import in_section
from eventlens.functions.timeutil import date_from_shard, utc_date, week_sunday
from eventlens.operators.joins import KEY, left_join_keyed, with_key
from eventlens.operators.login import first_login, first_time_label
from eventlens.operators.range_exists import followed_within
from eventlens.plans.common import BANNER, GAMEPLAY, flag, scan
from eventlens.sources.events import shard_range

# Fixed labels.
CLICKERS = "BANNER_CLICKERS"
NON_CLICKERS = "NON_CLICKERS"
RETURN_LO_US = 1_000_000        # TIMESTAMP_DIFF(..., SECOND) > 0
RETURN_HI_US = 300_999_999      # TIMESTAMP_DIFF(..., SECOND) <= 300
LOGIN = "login_success"

def _ev():
    return F.col("event_name")


def _first_logins(events: DataFrame) -> DataFrame:
    """First login per user, by the join's key."""
    return first_login(with_key(events.select("event_name", "event_timestamp", "user_id"), "user_id"), user_col=KEY)


def banner_return_vs_gameplay_weekly(events: DataFrame, date_from: str, date_to: str,
                                     section_path: str = "/tr/casino") -> DataFrame:
    """Q19: weekly (Sunday weeks) banner clickers' return-within-5-minutes rate
    vs non-clickers' gameplay rate, first-time vs returning users.

    Clickers: distinct (user, session, click time, type); returned when the
    same user has any section event 1..300 whole seconds later.  Non-clickers:
    distinct (user, session, shard date, type) of section events whose (user,
    session) has no banner click (NULL keys kept); gameplay = a gameplay event
    with the same (user, session).  Rates divide by distinct session ids, as the
    source; a group whose events all lack a session id has rate NULL (the source
    would fail with a division by zero).

    The section and gameplay events are one tagged stream: ``followed_within``
    marks the clicks, then every event counts for its session's day and every
    click for itself.  Days and clicks of a session are aggregated, map-side
    first, and then meet the first logins in a single join, where a frequent
    user's rows are spread.  No job runs while the frame is built."""
    ev = scan(events, date_from, date_to, ["ga_session_id", "page_location"],
              ["user_id", "event_name", "event_timestamp", "event_date"])
    sect = F.coalesce(in_section("page_location", section_path), F.lit(False))
    ev = ev.select("user_id", "session_id", "event_timestamp", "event_date", sect.alias("_sect"),
                   (_ev() == GAMEPLAY).alias("_game"), (sect & (_ev() == BANNER)).alias("_click"))
    ev = ev.filter(F.col("_sect") | F.col("_game"))
    ev = followed_within(ev, "user_id", "event_timestamp", F.col("_sect"), RETURN_LO_US, RETURN_HI_US, "_back")

    # Per event one row for its session's day, and per click one for the click.
    # A day is a UTC day: first and last time of a span below 24 hours tell
    # whether any event of it lies within 24 hours of the first login.
    ts, nothing = F.col("event_timestamp"), F.lit(None)
    keyed = F.col("user_id").isNotNull() & F.col("session_id").isNotNull()
    visit = F.struct(nothing.cast("long").alias("click_ts"), F.when(F.col("_sect"), F.col("event_date")).alias("day"),
                     F.when(F.col("_sect"), utc_date(ts)).alias("utc_day"), flag(keyed & F.col("_click")).alias("clicked"),
                     flag(keyed & F.col("_game")).alias("metric"))
    click = F.struct(ts.alias("click_ts"), nothing.cast("string").alias("day"), nothing.cast("date").alias("utc_day"),
                     F.lit(0).alias("clicked"), F.col("_back").alias("metric"))
    tagged = ev.select("user_id", "session_id", ts, F.inline(
        F.when(F.col("_click"), F.array(visit, click)).otherwise(F.array(visit))))
    days = tagged.groupBy("user_id", "session_id", "click_ts", "day", "utc_day").agg(
        F.min("event_timestamp").alias("lo"), F.max("event_timestamp").alias("hi"),
        F.max("clicked").alias("clicked"), F.max("metric").alias("metric"))
    span = F.when(F.col("day").isNotNull(), F.struct("day", "lo", "hi"))
    rows = days.groupBy("user_id", "session_id", "click_ts").agg(
        F.collect_list(span).alias("spans"), F.max("clicked").alias("clicked"), F.max("metric").alias("metric"))
    rows = rows.filter(F.col("click_ts").isNotNull() | ((F.col("clicked") == 0) & (F.size("spans") > 0))).drop("clicked")

    logins = _first_logins(shard_range(events, date_from, date_to))
    rows = left_join_keyed(rows, logins, ["user_id"], frequent=True)

    def types(s):
        """The day and user types of one span: both types when its ends differ."""
        ends = F.array_distinct(F.array(*[first_time_label(s[end]) for end in ("lo", "hi")]))
        return F.transform(ends, lambda t: F.struct(date_from_shard(s["day"]).alias("date"), t.alias("user_type")))

    clicked = F.array(F.struct(utc_date("click_ts").alias("date"), first_time_label("click_ts").alias("user_type")))
    visited = F.array_distinct(F.flatten(F.transform("spans", types)))
    is_click = F.col("click_ts").isNotNull()
    rows = rows.select("user_id", "session_id", "metric", F.when(is_click, F.lit(CLICKERS)).otherwise(F.lit(NON_CLICKERS)).alias("group_type"),
                       F.inline(F.when(is_click, clicked).otherwise(visited)))
    out = rows.groupBy(F.date_format(week_sunday("date"), "yyyy-MM-dd").alias("week_start"), "user_type", "group_type").agg(
        F.count_distinct("session_id").alias("sessions"), F.count_distinct("user_id").alias("unique_users"),
        F.sum("metric").cast("long").alias("key_metric"))
    rate = F.round(F.try_divide((F.lit(100) * F.col("key_metric")).cast("double"),
                                F.col("sessions").cast("double")), 2)
    return out.select("week_start", "user_type", "group_type", "sessions", "unique_users", "key_metric",
                      rate.alias("engagement_rate_pct")).orderBy(F.desc("week_start"), "user_type", "group_type")


def lobby_bounce_rate(events: DataFrame, date_from: str, date_to: str,
                      section_path: str = "/tr/casino", low_events: int = 2,
                      accuracy: int = 10000) -> DataFrame:
    """Q20: bounce rate (sessions with at most ``low_events`` section events),
    first-time vs returning by session start vs first login."""
    ev = scan(events, date_from, date_to, ["ga_session_id", "page_location"],
              ["user_id", "event_name", "event_timestamp"])
    logins = _first_logins(ev)
    sess = (ev.filter(in_section("page_location", section_path) & F.col("session_id").isNotNull())
            .groupBy("user_id", "session_id").agg(
                F.count(F.lit(1)).alias("session_events"),
                F.min("event_timestamp").alias("session_start_ts")))
    s = left_join_keyed(sess, logins, ["user_id"], frequent=True)
    s = s.select("user_id", "session_id", "session_events",
                 first_time_label("session_start_ts").alias("user_type"))
    low = F.sum(flag(F.col("session_events") <= low_events)).cast("long")
    dist = F.count_distinct("session_id")
    out = s.groupBy("user_type").agg(
        dist.alias("total_sessions"),
        F.count_distinct("user_id").alias("unique_users"),
        low.alias("low_engagement_sessions"),
        F.round(F.lit(100) * low / F.nullif(dist, F.lit(0)), 2).alias("bounce_rate_pct"),
        F.round(F.avg("session_events"), 2).alias("avg_events_per_session"),
        F.round(F.percentile_approx("session_events", 0.5, accuracy).cast("double"), 2)
        .alias("median_events_per_session"))
    return out.orderBy(F.desc("user_type"))
