"""Session KPI analyses on lobby sessions (Q07, Q09, Q11, Q12, Q13).

All five share one shape: lobby sessions (page views on the lobby page,
mobile and tablet) with metrics over every event of the session.  They are
built on ``lobby_session_rollup`` (hash aggregation per session, no join
back; a second small pass merges the string attribute OS); see
``eventlens.operators.sessions`` for why that equals the join form, NULL-key
sessions included (they stay in the denominators with no-match metrics).  The
same analyses take a table of daily session states in place of the events
(``plans.session_states``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from eventlens.functions.identity import user_type_by_session_number
from eventlens.functions.predicates import lobby_root, lobby_root_any_locale
from eventlens.functions.timeutil import secs_between, utc_date, week_monday
from eventlens.operators.sessions import NOT_KEYED, lobby_session_rollup
from eventlens.plans.common import PAGE_VIEW, flag, scan
from eventlens.plans.session_states import DAILY_EVENTS, SIGNALS, is_states, lobby_row, sessions_from_states, signal

def _rollup_metric(kind: str, name: str) -> tuple[str, Column, object]:
    """A metric over the events of a session: first ``MIN(IF(cond, ts, NULL))``,
    count ``COUNTIF(cond)``, has ``MAX(IF(cond, 1, 0))`` (0 when nothing
    matched), daily ``LOGICAL_OR(cond)`` over the daily events only (NULL when
    the session has none of them, three-valued otherwise)."""
    cond = signal(name)
    return {"first": ("min", F.when(cond, F.col("event_timestamp")), NOT_KEYED),
            "count": ("count_if", cond, 0),
            "has": ("max", flag(cond), 0),
            "daily": ("bool_or", F.when(F.col("event_name").isin(*DAILY_EVENTS), cond), NOT_KEYED)}[kind]


def _sessions(events: DataFrame, date_from: str, date_to: str, lobby: str, metrics: Mapping[str, tuple[str, str]],
              user_col: str = "user_id", **path: str) -> DataFrame:
    """Lobby sessions with ``metrics`` (name -> kind and signal), rolled up from
    events or merged from daily states (``session_states``).

    Only page views and the events that the metrics read are scanned; no other
    event can change a session's row.  Brand, host and device category of the
    source's per-session stage are functionally dependent on the session and
    never reach an output, so they are not computed."""
    if is_states(events):
        return sessions_from_states(events, date_from, date_to, lobby, metrics, user_col, **path)
    names = {SIGNALS[s] for _, s in metrics.values()}
    if any(kind == "daily" for kind, _ in metrics.values()):
        names.update(DAILY_EVENTS)
    used = events.filter(F.col("event_name").isin(PAGE_VIEW, *sorted(names)))
    ev = scan(used, date_from, date_to, ["ga_session_id", "ga_session_number", "page_location", "navigation_selection"],
              [user_col, "event_name", "event_timestamp", "device_category", "operating_system"])
    here = lobby_root("page_location", path["lobby_path"]) if lobby == "root" else \
        lobby_root_any_locale("page_location", path["locale"], path["section"])
    return lobby_session_rollup(
        ev, lobby_row(here), user_col=user_col,
        attrs={"operating_system": (F.col("operating_system"), "min"),
               "ga_session_number": (F.col("ga_session_number"), "max")},
        metrics={name: _rollup_metric(*metric) for name, metric in metrics.items()})


def baseline_sessions(events: DataFrame, date_from: str, date_to: str, locale: str = "tr", section: str = "casino") -> DataFrame:
    """The lobby sessions of Q07."""
    return _sessions(events, date_from, date_to, "any", {
        "first_gameplay_ts": ("first", "gameplay"), "gameplay_events": ("count", "gameplay"), "has_gameplay": ("has", "gameplay"),
        "promo_click_events": ("count", "promo"), "has_promo_click": ("has", "promo"),
        "has_search_window": ("has", "search"), "has_scroll": ("has", "scroll"),
        "has_deposit_window_opened": ("has", "deposit_window"), "has_deposit_success": ("has", "deposit_success"),
    }, locale=locale, section=section)


def lobby_session_baseline(events: DataFrame, date_from: str, date_to: str,
                           locale: str = "tr", section: str = "casino",
                           accuracy: int = 10000) -> DataFrame:
    """Q07: session KPI baseline (gameplay, promo, discovery, deposit guardrails,
    median and p75 time to first game) by user type and OS."""
    sess = baseline_sessions(events, date_from, date_to, locale, section)
    ttf = secs_between("first_gameplay_ts", "lobby_first_ts")
    q = F.percentile_approx(ttf, [0.5, 0.75], accuracy)
    out = sess.groupBy(user_type_by_session_number().alias("user_type"), "operating_system").agg(
        F.count(F.lit(1)).alias("lobby_sessions"),
        F.avg("has_gameplay").alias("gameplay_session_rate"),
        F.avg("gameplay_events").alias("avg_gameplay_events_per_session"),
        F.avg("has_promo_click").alias("promo_click_session_rate"),
        F.avg("promo_click_events").alias("avg_promo_clicks_per_session"),
        F.avg("has_scroll").alias("pct_sessions_with_scroll"),
        F.avg("has_search_window").alias("pct_sessions_with_search"),
        F.avg("has_deposit_window_opened").alias("pct_sessions_deposit_window"),
        F.avg("has_deposit_success").alias("pct_sessions_deposit_success"),
        q.alias("_q"))
    out = out.withColumn("median_time_to_first_gameplay_sec", F.col("_q")[0]) \
             .withColumn("p75_time_to_first_gameplay_sec", F.col("_q")[1]).drop("_q")
    return out.orderBy(F.desc("lobby_sessions"), "user_type", "operating_system")


def fast_game_start_rates(events: DataFrame, date_from: str, date_to: str,
                          lobby_path: str = "/tr/casino",
                          thresholds: Sequence[int] = (10, 15, 30, 60)) -> DataFrame:
    """Q09: share of lobby sessions starting a game within N seconds of the
    first lobby view (negative times, i.e. a game before the lobby, count)."""
    sess = _sessions(events, date_from, date_to, "root", {
        "first_gameplay_ts": ("first", "gameplay"), "first_promo_click_ts": ("first", "promo")}, lobby_path=lobby_path)
    fg, fp = F.col("first_gameplay_ts"), F.col("first_promo_click_ts")
    ttf = secs_between(fg, "lobby_first_ts")
    has_g = fg.isNotNull()
    aggs = [F.count(F.lit(1)).alias("sessions"),
            F.avg(has_g.cast("int")).alias("gameplay_anytime_rate")]
    aggs += [F.avg(flag(has_g & (ttf <= t))).alias(f"gameplay_within_{t}s_rate") for t in thresholds]
    aggs += [F.avg(fp.isNotNull().cast("int")).alias("promo_click_anytime_rate"),
             F.avg((fp.isNotNull() & fg.isNotNull() & (fp < fg)).cast("int"))
             .alias("promo_click_before_gameplay_rate")]
    out = sess.groupBy(user_type_by_session_number().alias("user_type"), "operating_system").agg(*aggs)
    return out.orderBy(F.desc("sessions"), "user_type", "operating_system")


def weekly_lobby_kpi(events: DataFrame, date_from: str, date_to: str,
                     lobby_path: str = "/tr/casino", by_identity: bool = False) -> DataFrame:
    """Q11: weekly (Monday weeks of the first lobby view, UTC) KPI trend.

    As in the source, the per-session stage groups by (week, OS, user type,
    session start) without the session identity, so sessions that share a
    start microsecond merge.  ``by_identity=True`` keeps every session as its
    own row (the corrected form)."""
    sess = _sessions(events, date_from, date_to, "root", {
        "first_gameplay_ts": ("first", "gameplay"), "first_promo_ts": ("first", "promo"),
        "has_deposit_success": ("has", "deposit_success"), "has_deposit_initiated": ("has", "deposit_initiated"),
        "has_deposit_window_opened": ("has", "deposit_window"), "has_scroll": ("has", "scroll"),
        "has_search_window": ("has", "search")}, lobby_path=lobby_path)
    flags = ["has_deposit_success", "has_deposit_initiated", "has_deposit_window_opened",
             "has_scroll", "has_search_window"]
    identity = ["user_id", "session_id"] if by_identity else []
    merged = sess.groupBy(
        week_monday(utc_date("lobby_first_ts")).alias("week_start"), "operating_system",
        user_type_by_session_number().alias("user_type"),
        F.col("lobby_first_ts").alias("session_start_ts"), *identity).agg(
        F.min("first_gameplay_ts").alias("first_gameplay_ts"),
        F.min("first_promo_ts").alias("first_promo_ts"),
        *[F.max(c).alias(c) for c in flags])
    fg, fp = F.col("first_gameplay_ts"), F.col("first_promo_ts")
    ttf = secs_between(fg, "session_start_ts")
    has_g = fg.isNotNull()
    out = merged.groupBy("week_start", "operating_system", "user_type").agg(
        F.count(F.lit(1)).alias("sessions"),
        F.avg(has_g.cast("int")).alias("gameplay_anytime_rate"),
        F.avg(flag(has_g & (ttf <= 15))).alias("gameplay_within_15s_rate"),
        F.avg(flag(has_g & (ttf <= 30))).alias("gameplay_within_30s_rate"),
        F.avg(fp.isNotNull().cast("int")).alias("promo_event_rate"),
        F.avg((fp.isNotNull() & fg.isNotNull() & (fp < fg)).cast("int")).alias("promo_before_gameplay_rate"),
        F.avg("has_deposit_window_opened").alias("deposit_window_rate"),
        F.avg("has_deposit_initiated").alias("deposit_initiated_rate"),
        F.avg("has_deposit_success").alias("deposit_success_rate"),
        F.avg("has_scroll").alias("scroll_rate"),
        F.avg("has_search_window").alias("search_rate"))
    return out.orderBy(F.desc("week_start"), F.desc("sessions"), "operating_system", "user_type")


def daily_lobby_kpi(events: DataFrame, date_from: str, date_to: str,
                    lobby_path: str = "/tr/casino", user_col: str = "user_id") -> DataFrame:
    """Q12 / Q13: daily KPI and data-quality check of mobile lobby sessions.

    Flags are ``LOGICAL_OR`` over the session's events of five types, so a
    session without any of them has NULL flags, which the rate averages skip
    (the time-threshold rates use CASE and count every session).  Q13 is
    ``user_col="user_pseudo_id"``."""
    sess = _sessions(events, date_from, date_to, "root", {
        "first_gameplay_ts": ("first", "gameplay"), "has_gameplay": ("daily", "gameplay"), "has_promo_click": ("daily", "promo"),
        "has_deposit_window": ("daily", "deposit_window"), "has_deposit_initiated": ("daily", "deposit_initiated"),
        "has_deposit_success": ("daily", "deposit_success")}, user_col, lobby_path=lobby_path)
    ttf = secs_between("first_gameplay_ts", "lobby_first_ts")
    g = F.col("has_gameplay")
    out = sess.groupBy(utc_date("lobby_first_ts").alias("activity_date"), "operating_system",
                       user_type_by_session_number().alias("user_type")).agg(
        F.count(F.lit(1)).alias("sessions"),
        F.avg(g.cast("int")).alias("gameplay_anytime_rate"),
        F.avg(flag(g & (ttf <= 15))).alias("gameplay_within_15s_rate"),
        F.avg(flag(g & (ttf <= 30))).alias("gameplay_within_30s_rate"),
        F.avg(F.col("has_promo_click").cast("int")).alias("promo_click_rate"),
        F.avg(F.col("has_deposit_window").cast("int")).alias("deposit_window_rate"),
        F.avg(F.col("has_deposit_initiated").cast("int")).alias("deposit_initiated_rate"),
        F.avg(F.col("has_deposit_success").cast("int")).alias("deposit_success_rate"))
    return out.orderBy(F.desc("activity_date"), F.desc("sessions"), "operating_system", "user_type")
