"""Cohort and funnel analyses (Q14-Q18).

User type comes from ``user_cohort`` over a lookback range (first event
before the cutoff: RETURNING_USER).  The activity side is aggregated per
(user, session, period), which spreads a frequent user's sessions over all
tasks, and each task then reduces them to counts per (user, period, flags)
*before* they meet the per-user cohort table: a user has at most a few rows per
period there, however many events or sessions, so no key of the join is
frequent.  The NULL user, which the inner join to the cohort drops, is filtered
before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from eventlens.functions.predicates import in_section
from eventlens.functions.timeutil import utc_date, week_num_sunday
from eventlens.operators.cohort import user_cohort
from eventlens.plans.common import BANNER, GAMEPLAY, flag, pct, scan

DEPOSIT_OK = "deposit_success"
CAROUSEL_EVENTS = ("menu_click", "carousel_next", "carousel_prev")
# Fixed labels.
WITH_CAROUSEL = "With Carousel Interaction"
NO_CAROUSEL = "No Carousel Interaction"
CLICKER = "BANNER_CLICKER"
NON_CLICKER = "NON_CLICKER"

def _ev():
    return F.col("event_name")


def _cohort(events: DataFrame, lookback_from: str, lookback_to: str, cutoff: str) -> DataFrame:
    ev = scan(events, lookback_from, lookback_to, [], ["user_id", "event_timestamp"])
    return user_cohort(ev, cutoff)


def _section_events(events: DataFrame, date_from: str, date_to: str, section_path: str) -> DataFrame:
    ev = scan(events, date_from, date_to, ["ga_session_id", "page_location"],
              ["user_id", "event_name", "event_timestamp"])
    return ev.filter(F.col("user_id").isNotNull() & in_section("page_location", section_path))


def user_segmentation(events: DataFrame, date_from: str, date_to: str, cutoff: str) -> DataFrame:
    """Q14: NEW vs RETURNING users and their share of all users.

    The NULL user forms a cohort row but is not counted as a user."""
    cohort = _cohort(events, date_from, date_to, cutoff)
    per_type = cohort.groupBy("user_type").agg(F.count("user_id").alias("total_users"))
    total = F.sum("total_users").over(Window.partitionBy())
    out = per_type.withColumn("pct_of_all_users",
                              F.col("total_users").cast("double") * F.lit(100.0) / total.cast("double"))
    return out.orderBy("user_type")


def _per_session_week(events, cohort_from, cohort_to, date_from, date_to, cutoff, section_path, flags):
    """(user_type, week_num, no_session, flags, n): numbers of (user, session,
    week) rows per combination of flags.

    The source counts distinct session keys, of which all rows without a
    session id share one (NULL); callers merge the rows with ``no_session``."""
    ev = _section_events(events, date_from, date_to, section_path)
    ev = ev.withColumn("week_num", week_num_sunday(utc_date("event_timestamp")))
    pre = ev.groupBy("user_id", "session_id", "week_num").agg(
        *[F.max(flag(cond)).alias(name) for name, cond in flags.items()])
    per_user = pre.groupBy("user_id", "week_num", F.col("session_id").isNull().alias("no_session"), *flags).agg(
        F.count(F.lit(1)).alias("n"))
    joined = per_user.join(_cohort(events, cohort_from, cohort_to, cutoff), "user_id", "inner")
    return joined.groupBy("user_type", "week_num", "no_session", *flags).agg(F.sum("n").alias("n"))


def _with(cond):
    """Sessions for which ``cond`` (of flags) holds."""
    return F.coalesce(F.sum(F.when(~F.col("no_session") & cond, F.col("n"))), F.lit(0))


def _null_max(name: str):
    """Flag of the one session key that rows without a session id share: 1, 0,
    or NULL without such rows."""
    return F.max(F.when(F.col("no_session"), F.col(name)))


def lobby_funnel_weekly(events: DataFrame, cohort_from: str, cohort_to: str, date_from: str,
                        date_to: str, cutoff: str, section_path: str = "/tr/casino",
                        corrected: bool = False) -> DataFrame:
    """Q15: weekly funnel of sessions in the lobby section: banner click, gameplay.

    ``gameplay_rate_among_banner_clickers`` keeps the source formula: all
    gameplay sessions divided by (clicked sessions + 1).  ``corrected=True``
    adds ``gameplay_pct_of_clicked_sessions``: sessions with both a banner
    click and a game, over clicked sessions."""
    s = _per_session_week(events, cohort_from, cohort_to, date_from, date_to, cutoff, section_path,
                          {"had_banner_click": _ev() == BANNER, "had_gameplay": _ev() == GAMEPLAY})
    click, game = F.col("had_banner_click") == 1, F.col("had_gameplay") == 1
    null_click, null_game = F.coalesce(_null_max("had_banner_click"), F.lit(0)), F.coalesce(_null_max("had_gameplay"), F.lit(0))
    c = s.groupBy("user_type", "week_num").agg(
        (_with(F.lit(True)) + F.max(F.col("no_session").cast("int"))).alias("total_casino_sessions"),
        (_with(click) + null_click).alias("sessions_banner_clicked"),
        (_with(game) + null_game).alias("sessions_gameplay_initiated"),
        (_with(click & game) + null_click * null_game).alias("_clicked_and_played"))
    tot, clk, gp = F.col("total_casino_sessions"), F.col("sessions_banner_clicked"), F.col("sessions_gameplay_initiated")
    out = c.select("week_num", "user_type", tot, clk,
                   pct(clk, tot).alias("pct_sessions_clicked_banner"), gp,
                   pct(gp, tot).alias("pct_sessions_gameplay"),
                   pct(gp, clk + 1).alias("gameplay_rate_among_banner_clickers"),
                   *([pct(F.col("_clicked_and_played"), clk).alias("gameplay_pct_of_clicked_sessions")]
                     if corrected else []))
    return out.orderBy("week_num", "user_type")


def carousel_friction(events: DataFrame, cohort_from: str, cohort_to: str, date_from: str,
                      date_to: str, cutoff: str, section_path: str = "/tr/casino") -> DataFrame:
    """Q16: gameplay conversion of sessions with vs without carousel/menu clicks.

    ``conversion_rank`` orders by conversion desc; ties are broken by the
    engagement label so the rank is deterministic."""
    s = _per_session_week(events, cohort_from, cohort_to, date_from, date_to, cutoff, section_path,
                          {"had_carousel_interaction": _ev().isin(*CAROUSEL_EVENTS),
                           "reached_gameplay": _ev() == GAMEPLAY})
    flag_of = F.col("had_carousel_interaction")
    null_flag, null_game = _null_max("had_carousel_interaction"), F.coalesce(_null_max("reached_gameplay"), F.lit(0))
    sides = [F.struct(
        F.lit(v).alias("had_carousel_interaction"),
        (_with(flag_of == v) + F.when(null_flag == v, F.lit(1)).otherwise(F.lit(0))).alias("session_count"),
        (_with((flag_of == v) & (F.col("reached_gameplay") == 1)) + F.when(null_flag == v, null_game).otherwise(F.lit(0)))
        .alias("sessions_with_gameplay")) for v in (0, 1)]
    f = s.groupBy("week_num", "user_type").agg(F.array(*sides).alias("sides")) \
         .select("week_num", "user_type", F.inline("sides")).filter("session_count > 0")
    f = f.withColumn("gameplay_conversion_pct", pct(F.col("sessions_with_gameplay"), F.col("session_count")))
    label = F.when(F.col("had_carousel_interaction") == 1, F.lit(WITH_CAROUSEL)).otherwise(F.lit(NO_CAROUSEL))
    f = f.withColumn("carousel_engagement", label)
    w = Window.partitionBy("week_num", "user_type").orderBy(
        F.desc("gameplay_conversion_pct"), F.asc("carousel_engagement"))
    out = f.select("week_num", "user_type", "carousel_engagement", "session_count",
                   "sessions_with_gameplay", "gameplay_conversion_pct",
                   F.row_number().over(w).cast("long").alias("conversion_rank"))
    return out.orderBy("week_num", "user_type", "carousel_engagement")


def clicker_deposit_conversion(events: DataFrame, cohort_from: str, cohort_to: str, date_from: str,
                               date_to: str, cutoff: str, section_path: str = "/tr/casino") -> DataFrame:
    """Q17: deposit conversion of banner clickers vs non-clickers, distinct users.

    One pass per user: clicked a banner in the section, visited the section,
    had a deposit success anywhere.  Non-clickers are section visitors that are
    not clickers (the NOT IN of the source; both sides are non-NULL)."""
    ev = scan(events, date_from, date_to, ["page_location"], ["user_id", "event_name"])
    ev = ev.filter(F.col("user_id").isNotNull())
    sect = in_section("page_location", section_path)
    users = ev.filter(sect | (_ev() == DEPOSIT_OK)).groupBy("user_id").agg(   # others answer nothing here
        F.max(flag((_ev() == BANNER) & sect)).alias("clicked"),
        F.max(flag(sect)).alias("visited"),
        F.max(flag(_ev() == DEPOSIT_OK)).alias("deposited"))
    cohort = _cohort(events, cohort_from, cohort_to, cutoff)
    u = users.join(cohort, "user_id", "inner")
    is_clk = F.col("clicked") == 1
    is_non = (F.col("visited") == 1) & (F.col("clicked") == 0)
    dep = F.col("deposited") == 1
    g = u.groupBy("user_type").agg(
        F.count_if(is_clk).alias("c_users"), F.count_if(is_clk & dep).alias("c_dep"),
        F.count_if(is_non).alias("n_users"), F.count_if(is_non & dep).alias("n_dep"))
    rows = g.select("user_type", F.inline(F.array(
        F.struct(F.lit(CLICKER).alias("group_type"), F.col("c_users").alias("total_users"),
                 F.col("c_dep").alias("users_deposited")),
        F.struct(F.lit(NON_CLICKER).alias("group_type"), F.col("n_users").alias("total_users"),
                 F.col("n_dep").alias("users_deposited")))))
    rows = rows.filter(F.col("total_users") > 0)
    out = rows.select("user_type", "group_type", "total_users", "users_deposited",
                      pct(F.col("users_deposited"), F.col("total_users")).alias("deposit_conversion_rate_pct"))
    return out.orderBy("user_type", "group_type")


def daily_trend_moving_avg(events: DataFrame, cohort_from: str, cohort_to: str, date_from: str,
                           date_to: str, cutoff: str, section_path: str = "/tr/casino") -> DataFrame:
    """Q18: daily sessions, banner clicks, gameplay and deposits in the section
    with a 7-row (not 7-day) moving average of the gameplay rate."""
    return _daily_trend(events, _cohort(events, cohort_from, cohort_to, cutoff), date_from, date_to, section_path)


def _daily_trend(events: DataFrame, cohort: DataFrame, date_from: str, date_to: str, section_path: str) -> DataFrame:
    ev = _section_events(events, date_from, date_to, section_path)
    ev = ev.withColumn("activity_date", utc_date("event_timestamp"))
    pre = ev.groupBy("activity_date", "user_id", "session_id").agg(
        F.count_if(_ev() == BANNER).alias("c"), F.count_if(_ev() == GAMEPLAY).alias("g"),
        F.count_if(_ev() == DEPOSIT_OK).alias("d"))
    per_user = pre.groupBy("activity_date", "user_id").agg(
        F.count("session_id").alias("n"), F.sum("c").alias("c"), F.sum("g").alias("g"), F.sum("d").alias("d"))
    j = per_user.join(cohort, "user_id", "inner")
    daily = j.groupBy("activity_date", "user_type").agg(
        F.sum("n").cast("long").alias("total_casino_sessions"),
        F.sum("c").cast("long").alias("banner_clicks"),
        F.sum("g").cast("long").alias("gameplay_initiations"),
        F.sum("d").cast("long").alias("deposits"))
    s, c, g = F.col("total_casino_sessions"), F.col("banner_clicks"), F.col("gameplay_initiations")
    rate = F.lit(100.0) * g.cast("double") / F.nullif(s, F.lit(0)).cast("double")
    w = Window.partitionBy("user_type").orderBy("activity_date").rowsBetween(-6, Window.currentRow)
    out = daily.select("activity_date", "user_type", s, c, pct(c, s).alias("banner_click_rate_pct"),
                       g, pct(g, s).alias("gameplay_rate_pct"), "deposits",
                       F.avg(rate).over(w).alias("gameplay_rate_7day_ma"))
    return out.orderBy("activity_date", "user_type")
