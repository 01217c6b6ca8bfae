"""Independent DuckDB formulations of the registered analyses.

Each statement derives the flat logical event view ``ev`` (and payments view
``pay``) from the driver tables with the fixture formulas (FIXTURES.md §3-4),
then computes the analysis from its specification (SURVEY §2N) in plain
DuckDB SQL, deliberately by other means than the Spark code: lobby sessions
joined to their events with FILTER aggregates (Spark: one aggregation, no
join), an ASOF join for the 5-minute return (Spark: bucketed window), EXCEPT
for non-clickers (Spark: per-user flags), anti-joins by NULL-marker left
joins, nearest-rank percentiles by ROW_NUMBER.  Nothing here is shared with
the Spark code, so agreement checks it.

Money (payment amounts, two decimals) is summed in integer cents and means
are rounded half up with integer division: DuckDB's parallel DOUBLE summation
order varies between runs and its AVG/division of DECIMALs return DOUBLE, so a
mean that falls exactly on a rounding tie (e.g. 352.115) would round either
way from run to run.  The mean of per-player means (Q22) keeps 12 and then 16
decimals, the scales of SQL decimal AVG.

Conventions (DuckDB differs from the source dialect): ``||`` instead of
``concat`` (NULL-propagating), ``NULLIF(regexp_extract(..), '')`` for the
host, BIGINT casts on integer sums, ``100.0::DOUBLE``, ``date_sub('second')``
for truncated second differences, nearest-rank percentiles via ROW_NUMBER,
explicit NULLS FIRST where a LIMIT cuts ties.
"""

from __future__ import annotations

LO, HI = "20231231", "20240131"
CUTOFF = "2024-01-09"
HOME = "https://site%.com"

BASE = r"""
WITH b0 AS (
  SELECT event_id AS eid, user_id AS uid, event_type AS etype,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
         epoch_us(ts) AS us
  FROM events
),
b1 AS (SELECT *, us - us % 259200000000 AS s_us FROM b0),
b2 AS (SELECT *, (s_us - 1703980800000000) // 259200000000 + 1 AS sn FROM b1),
b3 AS (
  SELECT eid, uid, etype, k, us + 259200000000 * l AS us, s_us + 259200000000 * l AS s_us, sn + l AS sn
  FROM (SELECT *, CASE WHEN uid % 4 = 3 AND sn < 4 THEN 3 ELSE 0 END AS l FROM b2)
),
b4 AS (
  SELECT *,
    s_us + (us - s_us) // 500 AS event_timestamp,
    CASE etype
      WHEN 'view' THEN 'page_view'
      WHEN 'click' THEN CASE WHEN k < 40 THEN 'dynamic_content' WHEN k < 55 THEN 'menu_click'
                             WHEN k < 70 THEN 'scroll' WHEN k < 80 THEN 'search_window_initiated'
                             WHEN k < 90 THEN 'carousel_next' ELSE 'carousel_prev' END
      WHEN 'purchase' THEN CASE WHEN k < 40 THEN 'deposit_window_opened' WHEN k < 70 THEN 'deposit_initiated'
                                ELSE 'deposit_success' END
      WHEN 'signup' THEN CASE WHEN k < 50 THEN 'login_success' ELSE 'session_start' END
      WHEN 'error' THEN CASE WHEN k < 80 THEN 'gameplay_initiated' ELSE 'deposit_failed' END
    END AS event_name,
    'https://site' || CAST(800 + (uid + k % 2) % 7 AS VARCHAR) || '.example.com' ||
    CASE eid % 10
      WHEN 0 THEN '/tr/casino'
      WHEN 1 THEN '/tr/casino/'
      WHEN 2 THEN '/tr/casino?utm=' || CAST(k AS VARCHAR)
      WHEN 3 THEN '/tr/casino/?a=' || CAST(k AS VARCHAR)
      WHEN 4 THEN '/casino'
      WHEN 5 THEN '/tr/casino/slots/' || CAST(k AS VARCHAR)
      WHEN 6 THEN '/tr/canli-casino/' || CAST(k AS VARCHAR)
      WHEN 7 THEN CASE WHEN k < 50 THEN '/tr/bahis/' || CAST(k AS VARCHAR) ELSE '/tr/canli-bahis' END
      WHEN 8 THEN CASE WHEN k < 25 THEN '/' WHEN k < 50 THEN '/tr/account/' || CAST(k AS VARCHAR)
                       WHEN k < 75 THEN '/tr/destek' ELSE '/tr/virtual-football' END
      ELSE CASE WHEN k < 30 THEN '/tr/kampanyalar/' || CAST(k AS VARCHAR) WHEN k < 60 THEN '/tr/kayit-ol'
                WHEN k < 80 THEN '/tr/login' WHEN k < 90 THEN '/blog' ELSE NULL END
    END AS page_location
  FROM b3
),
ev AS (
  SELECT
    eid,
    event_timestamp,
    strftime(make_timestamp(event_timestamp), '%Y%m%d') AS event_date,
    event_name,
    CASE WHEN uid % 10 = 7 THEN NULL ELSE CAST(uid AS VARCHAR) END AS user_id,
    'p' || CAST(uid AS VARCHAR) AS user_pseudo_id,
    CASE WHEN eid % 20 = 13 THEN 'APP' ELSE 'WEB' END AS platform,
    CASE WHEN uid % 5 <= 2 THEN 'mobile' WHEN uid % 5 = 3 THEN 'tablet' ELSE 'desktop' END AS device_category,
    CASE WHEN uid % 5 = 4 THEN 'Windows' WHEN uid % 2 = 0 THEN 'Android' ELSE 'iOS' END AS operating_system,
    CASE WHEN eid % 97 = 0 THEN NULL ELSE s_us // 1000000 END AS session_id,
    CASE WHEN uid % 4 = 3 THEN sn - 3 ELSE sn END AS ga_session_number,
    page_location,
    CASE WHEN k % 11 = 0 THEN NULL ELSE 'brand' || CAST(uid % 2 AS VARCHAR) END AS brand,
    CASE WHEN event_name = 'dynamic_content' THEN 'type' || CAST(k % 5 AS VARCHAR) END AS content_type,
    CASE WHEN event_name = 'dynamic_content' THEN CASE WHEN k % 4 = 0 THEN 'HOMEPAGE' ELSE 'CASINO' END END AS user_interaction,
    CASE WHEN event_name = 'dynamic_content' THEN 'tr/kampanyalar/' || CAST(k % 6 AS VARCHAR) END AS click_target,
    CASE WHEN event_name = 'dynamic_content' THEN
      CASE WHEN k % 3 < 2 THEN 'Promotion Area' ELSE 'Hero Banner (Promotional)' END END AS navigation_selection,
    CASE WHEN event_name = 'dynamic_content' THEN k % 10 END AS idx,
    CASE WHEN uid % 6 = 0 THEN '' WHEN uid % 6 = 1 THEN NULL ELSE 'e' || CAST(uid AS VARCHAR) END AS "enhancedUserId",
    CASE WHEN uid % 6 = 0 THEN '' WHEN uid % 4 = 1 THEN 'c' || CAST(uid AS VARCHAR) ELSE NULL END AS customer_guid,
    CASE WHEN eid % 9 = 0 THEN NULL ELSE 's' || CAST(uid % 40 AS VARCHAR) END AS ssguid
  FROM b4
),
pay AS (
  SELECT
    CAST(o_custkey % 200 AS VARCHAR) AS player_id,
    CAST(DATE '2023-12-31' + CAST((CAST(o_orderdate AS DATE) - DATE '1970-01-01') % 32 AS INTEGER) AS VARCHAR) || ' 12:00:00' AS date_created,
    CASE WHEN o_orderkey % 50 = 0 THEN 0.0
         ELSE CAST(round(CAST(o_totalprice AS DECIMAL(18,2)) / 1000, 2) AS DOUBLE) END AS "transaction_amount_EUR",
    CASE o_orderstatus WHEN 'O' THEN 'CAPTURED' WHEN 'F' THEN 'COMPLETED' WHEN 'P' THEN 'DECLINED' END AS payment_status,
    CASE WHEN o_orderpriority = '1-URGENT' THEN 'OTHER' ELSE 'SITE_A' END AS business_unit_name
  FROM orders
)
"""

RX_TR = r"'/tr/casino/?(\?.*)?$'"
RX_ANY = r"'/(tr/)?casino/?(\?.*)?$'"
RX_BARE = r"'/casino/?(\?.*)?$'"
HOST = r"NULLIF(regexp_extract(page_location, 'https?://([^/]+)/', 1), '')"
IN_RANGE = f"event_date BETWEEN '{LO}' AND '{HI}'"
CUT_US = f"epoch_us(TIMESTAMP '{CUTOFF} 00:00:00')"
MOBILE = "device_category IN ('mobile', 'tablet')"
SECTION = "page_location LIKE '%/tr/casino/%'"
DAY_US = "86400000000"


def q(body: str) -> str:
    return BASE + body


def nearest_rank(src: str, keys: str, val: str, p: float, name: str) -> str:
    """CTE ``name(keys…, v)``: per group the value at rank ceil(p·n) of the
    non-NULL ``val`` (the nearest-rank percentile)."""
    return f"""
, {name} AS (
  SELECT {keys}, min(v) FILTER (WHERE r = CAST(ceil({p} * n) AS BIGINT)) AS v
  FROM (SELECT {keys}, {val} AS v, row_number() OVER (PARTITION BY {keys} ORDER BY {val}) AS r,
               count(*) OVER (PARTITION BY {keys}) AS n
        FROM {src} WHERE {val} IS NOT NULL)
  GROUP BY ALL
)"""


def lobby_visits(regex: str, user: str = "user_id") -> str:
    """CTE ``visits``: one row per (user, session) with a lobby page view
    (mobile/tablet); NULL keys are groups too."""
    return f"""
, visits AS (
  SELECT {user}, session_id, min(event_timestamp) AS t0, min(operating_system) AS os,
         max(ga_session_number) AS sn
  FROM ev
  WHERE {IN_RANGE} AND event_name = 'page_view' AND {MOBILE} AND regexp_matches(page_location, {regex})
  GROUP BY ALL
)"""


def with_events(cols: str, user: str = "user_id", names: str | None = None) -> str:
    """CTE ``facts``: every lobby session with aggregates over the events of
    the same (user, session) in range, one LEFT JOIN (no match for NULL keys)."""
    only = f" AND e.event_name IN ({names})" if names else ""
    return f"""
, facts AS (
  SELECT v.{user}, v.session_id, v.t0, v.os,
         CASE WHEN v.sn = 1 THEN 'NEW_USER' ELSE 'RETURNING_USER' END AS user_type,
         {cols}
  FROM visits v
  LEFT JOIN ev e ON e.{user} = v.{user} AND e.session_id = v.session_id AND e.{IN_RANGE}{only}
  GROUP BY ALL
)"""


GAME_TS = "min(e.event_timestamp) FILTER (WHERE e.event_name = 'gameplay_initiated') AS game_ts"
PROMO = "e.event_name = 'dynamic_content' AND e.navigation_selection = 'Promotion Area'"


def has(cond: str, name: str) -> str:
    return f"CASE WHEN count(*) FILTER (WHERE {cond}) > 0 THEN 1 ELSE 0 END AS {name}"


ORACLE: dict[str, str] = {}

ORACLE["lobby_volume_by_host_platform"] = q(f"""
SELECT {HOST} AS host, platform,
       count(DISTINCT user_id || '-' || session_id::VARCHAR) AS sessions,
       count(DISTINCT user_id) AS users
FROM ev
WHERE {IN_RANGE} AND event_name = 'page_view' AND session_id IS NOT NULL
  AND regexp_matches(page_location, {RX_TR})
GROUP BY ALL
""")

ORACLE["param_inventory_in_lobby_sessions"] = q(f"""
, present_keys AS (
            SELECT eid, 'ga_session_id' AS k FROM ev WHERE session_id IS NOT NULL
  UNION ALL SELECT eid, 'ga_session_number' FROM ev WHERE ga_session_number IS NOT NULL
  UNION ALL SELECT eid, 'page_location' FROM ev WHERE page_location IS NOT NULL
  UNION ALL SELECT eid, 'brand' FROM ev WHERE brand IS NOT NULL
  UNION ALL SELECT eid, 'content_type' FROM ev WHERE content_type IS NOT NULL
  UNION ALL SELECT eid, 'user_interaction' FROM ev WHERE user_interaction IS NOT NULL
  UNION ALL SELECT eid, 'click_target' FROM ev WHERE click_target IS NOT NULL
  UNION ALL SELECT eid, 'navigation_selection' FROM ev WHERE navigation_selection IS NOT NULL
  UNION ALL SELECT eid, 'index' FROM ev WHERE idx IS NOT NULL
  UNION ALL SELECT eid, 'enhancedUserId' FROM ev WHERE "enhancedUserId" IS NOT NULL
  UNION ALL SELECT eid, 'customer_guid' FROM ev WHERE customer_guid IS NOT NULL
  UNION ALL SELECT eid, 'ssguid' FROM ev WHERE ssguid IS NOT NULL
), saw_lobby AS (
  SELECT DISTINCT user_id, session_id FROM ev
  WHERE {IN_RANGE} AND event_name = 'page_view' AND regexp_matches(page_location, {RX_TR})
)
SELECT pk.k AS param_key, count(*) AS occurrences
FROM ev b JOIN present_keys pk ON pk.eid = b.eid
WHERE b.{IN_RANGE} AND b.event_name = 'dynamic_content'
  AND EXISTS (SELECT 1 FROM saw_lobby s WHERE s.user_id = b.user_id AND s.session_id = b.session_id)
GROUP BY ALL
""")

ORACLE["lobby_volume_by_device"] = q(f"""
SELECT {HOST} AS host, brand, platform, device_category, operating_system,
       count(DISTINCT user_id || '-' || session_id::VARCHAR) AS sessions,
       count(DISTINCT user_id) AS users
FROM ev
WHERE {IN_RANGE} AND event_name = 'page_view' AND session_id IS NOT NULL
  AND regexp_matches(page_location, {RX_TR})
GROUP BY ALL
""")

ORACLE["lobby_event_inventory"] = q(f"""
SELECT event_name, count(*) AS event_count
FROM ev
WHERE {IN_RANGE} AND platform = 'WEB' AND {MOBILE} AND regexp_matches(page_location, {RX_TR})
GROUP BY ALL
""")

ORACLE["banner_combination_topk"] = q(f"""
SELECT brand, content_type, user_interaction, click_target, navigation_selection, idx, count(*) AS events
FROM ev
WHERE {IN_RANGE} AND event_name = 'dynamic_content' AND platform = 'WEB' AND {MOBILE}
  AND regexp_matches(page_location, {RX_TR})
GROUP BY ALL
ORDER BY events DESC, brand NULLS FIRST, content_type NULLS FIRST, user_interaction NULLS FIRST,
         click_target NULLS FIRST, navigation_selection NULLS FIRST, idx NULLS FIRST
LIMIT 100
""")

ORACLE["lobby_sessions_by_url_variant"] = q(f"""
SELECT {HOST} AS host, brand,
       CASE WHEN regexp_matches(page_location, {RX_TR}) THEN 'tr/casino'
            WHEN regexp_matches(page_location, {RX_BARE}) THEN 'casino'
            ELSE 'other' END AS lobby_path_variant,
       operating_system,
       count(DISTINCT user_id || '-' || session_id::VARCHAR) AS sessions,
       count(DISTINCT user_id) AS users
FROM ev
WHERE {IN_RANGE} AND event_name = 'page_view' AND {MOBILE} AND session_id IS NOT NULL
  AND regexp_matches(page_location, {RX_ANY})
GROUP BY ALL
""")

ORACLE["lobby_session_baseline"] = q(lobby_visits(RX_ANY) + with_events(f"""{GAME_TS},
         count(*) FILTER (WHERE e.event_name = 'gameplay_initiated') AS games,
         count(*) FILTER (WHERE {PROMO}) AS promos,
         {has('e.event_name = ' + repr('scroll'), 'scrolled')},
         {has('e.event_name = ' + repr('search_window_initiated'), 'searched')},
         {has('e.event_name = ' + repr('deposit_window_opened'), 'dep_window')},
         {has('e.event_name = ' + repr('deposit_success'), 'dep_ok')}""") + """
, timed AS (SELECT *, (game_ts - t0) / 1000000.0 AS to_game FROM facts)
""" + nearest_rank("timed", "user_type, os", "to_game", 0.5, "med")
  + nearest_rank("timed", "user_type, os", "to_game", 0.75, "p75") + """
SELECT t.user_type, t.os AS operating_system, count(*) AS lobby_sessions,
       avg(CASE WHEN t.games > 0 THEN 1 ELSE 0 END) AS gameplay_session_rate,
       avg(t.games) AS avg_gameplay_events_per_session,
       avg(CASE WHEN t.promos > 0 THEN 1 ELSE 0 END) AS promo_click_session_rate,
       avg(t.promos) AS avg_promo_clicks_per_session,
       avg(t.scrolled) AS pct_sessions_with_scroll,
       avg(t.searched) AS pct_sessions_with_search,
       avg(t.dep_window) AS pct_sessions_deposit_window,
       avg(t.dep_ok) AS pct_sessions_deposit_success,
       any_value(med.v) AS median_time_to_first_gameplay_sec,
       any_value(p75.v) AS p75_time_to_first_gameplay_sec
FROM timed t
LEFT JOIN med ON med.user_type = t.user_type AND med.os IS NOT DISTINCT FROM t.os
LEFT JOIN p75 ON p75.user_type = t.user_type AND p75.os IS NOT DISTINCT FROM t.os
GROUP BY t.user_type, t.os
""")

ORACLE["multi_host_exposure"] = q(f"""
, per_identity AS (
  SELECT coalesce(nullif("enhancedUserId", ''), nullif(customer_guid, ''), nullif(ssguid, ''), user_id) AS who,
         count(DISTINCT {HOST}) AS distinct_hosts
  FROM ev
  WHERE {IN_RANGE} AND event_name = 'page_view' AND {MOBILE} AND regexp_matches(page_location, {RX_TR})
  GROUP BY 1
)
SELECT distinct_hosts, count(*) AS identities FROM per_identity GROUP BY ALL
""")

ORACLE["fast_game_start_rates"] = q(lobby_visits(RX_TR) + with_events(f"""{GAME_TS},
         min(e.event_timestamp) FILTER (WHERE {PROMO}) AS promo_ts""") + """
, timed AS (SELECT *, (game_ts - t0) / 1000000.0 AS to_game FROM facts)
SELECT user_type, os AS operating_system, count(*) AS sessions,
       avg((game_ts IS NOT NULL)::INTEGER) AS gameplay_anytime_rate,
       avg(CASE WHEN game_ts IS NOT NULL AND to_game <= 10 THEN 1 ELSE 0 END) AS gameplay_within_10s_rate,
       avg(CASE WHEN game_ts IS NOT NULL AND to_game <= 15 THEN 1 ELSE 0 END) AS gameplay_within_15s_rate,
       avg(CASE WHEN game_ts IS NOT NULL AND to_game <= 30 THEN 1 ELSE 0 END) AS gameplay_within_30s_rate,
       avg(CASE WHEN game_ts IS NOT NULL AND to_game <= 60 THEN 1 ELSE 0 END) AS gameplay_within_60s_rate,
       avg((promo_ts IS NOT NULL)::INTEGER) AS promo_click_anytime_rate,
       avg(coalesce(promo_ts < game_ts, false)::INTEGER) AS promo_click_before_gameplay_rate
FROM timed GROUP BY ALL
""")

ORACLE["identifier_coverage"] = q(f"""
, per_session AS (
  SELECT user_id, session_id, max(ga_session_number) AS sn, min(operating_system) AS os,
         bool_or(coalesce("enhancedUserId", '') <> '')::INTEGER AS e,
         bool_or(coalesce(customer_guid, '') <> '')::INTEGER AS c,
         bool_or(coalesce(ssguid, '') <> '')::INTEGER AS s
  FROM ev
  WHERE {IN_RANGE} AND event_name = 'page_view' AND {MOBILE} AND session_id IS NOT NULL
    AND regexp_matches(page_location, {RX_TR})
  GROUP BY user_id, session_id
)
SELECT CASE WHEN sn = 1 THEN 'NEW_USER' ELSE 'RETURNING_USER' END AS user_type, os AS operating_system,
       count(*) AS lobby_sessions, avg(e) AS "pct_sessions_with_enhancedUserId",
       avg(c) AS pct_sessions_with_customer_guid, avg(s) AS pct_sessions_with_ssguid
FROM per_session GROUP BY ALL
""")

WEEKLY_NAMES = ("'gameplay_initiated', 'dynamic_content', 'deposit_success', 'deposit_initiated', "
                "'deposit_window_opened', 'scroll', 'search_window_initiated'")

ORACLE["weekly_lobby_kpi"] = q(lobby_visits(RX_TR) + with_events(f"""{GAME_TS},
         min(e.event_timestamp) FILTER (WHERE {PROMO}) AS promo_ts,
         {has("e.event_name = 'deposit_success'", 'dep_ok')},
         {has("e.event_name = 'deposit_initiated'", 'dep_init')},
         {has("e.event_name = 'deposit_window_opened'", 'dep_window')},
         {has("e.event_name = 'scroll'", 'scrolled')},
         {has("e.event_name = 'search_window_initiated'", 'searched')}""", names=WEEKLY_NAMES) + """
, merged AS (  -- sessions sharing week, OS, type and start microsecond count once
  SELECT CAST(date_trunc('week', CAST(make_timestamp(t0) AS DATE)) AS DATE) AS week_start, os, user_type, t0,
         min(game_ts) AS game_ts, min(promo_ts) AS promo_ts, max(dep_ok) AS dep_ok, max(dep_init) AS dep_init,
         max(dep_window) AS dep_window, max(scrolled) AS scrolled, max(searched) AS searched
  FROM facts GROUP BY ALL
)
SELECT week_start, os AS operating_system, user_type, count(*) AS sessions,
       avg((game_ts IS NOT NULL)::INTEGER) AS gameplay_anytime_rate,
       avg(CASE WHEN game_ts - t0 <= 15000000 THEN 1 ELSE 0 END) AS gameplay_within_15s_rate,
       avg(CASE WHEN game_ts - t0 <= 30000000 THEN 1 ELSE 0 END) AS gameplay_within_30s_rate,
       avg((promo_ts IS NOT NULL)::INTEGER) AS promo_event_rate,
       avg(coalesce(promo_ts < game_ts, false)::INTEGER) AS promo_before_gameplay_rate,
       avg(dep_window) AS deposit_window_rate, avg(dep_init) AS deposit_initiated_rate,
       avg(dep_ok) AS deposit_success_rate, avg(scrolled) AS scroll_rate, avg(searched) AS search_rate
FROM merged GROUP BY ALL
""")

DAILY_NAMES = "'gameplay_initiated', 'dynamic_content', 'deposit_success', 'deposit_initiated', 'deposit_window_opened'"


def daily_kpi(user: str) -> str:
    return q(lobby_visits(RX_TR, user) + with_events(f"""{GAME_TS},
         bool_or(e.event_name = 'gameplay_initiated') AS g,
         bool_or({PROMO}) AS p,
         bool_or(e.event_name = 'deposit_window_opened') AS w,
         bool_or(e.event_name = 'deposit_initiated') AS i,
         bool_or(e.event_name = 'deposit_success') AS d""", user=user, names=DAILY_NAMES) + """
, daily AS (
  SELECT CAST(make_timestamp(t0) AS DATE) AS activity_date, os AS operating_system, user_type, count(*) AS sessions,
         avg(g::INTEGER) AS gameplay_anytime_rate,
         avg(CASE WHEN g AND (game_ts - t0) / 1000000.0 <= 15 THEN 1 ELSE 0 END) AS gameplay_within_15s_rate,
         avg(CASE WHEN g AND (game_ts - t0) / 1000000.0 <= 30 THEN 1 ELSE 0 END) AS gameplay_within_30s_rate,
         avg(p::INTEGER) AS promo_click_rate, avg(w::INTEGER) AS deposit_window_rate,
         avg(i::INTEGER) AS deposit_initiated_rate, avg(d::INTEGER) AS deposit_success_rate
  FROM facts GROUP BY ALL
)""")


ORACLE["daily_lobby_kpi"] = daily_kpi("user_id") + "\nSELECT * FROM daily\n"
ORACLE["daily_lobby_kpi_pseudo_id"] = daily_kpi("user_pseudo_id") + "\nSELECT * FROM daily\n"

COHORT = f"""
, cohort AS (
  SELECT user_id,
         CASE WHEN min(event_timestamp) < {CUT_US} THEN 'RETURNING_USER' ELSE 'NEW_USER' END AS user_type
  FROM ev WHERE {IN_RANGE} GROUP BY user_id
)"""

ORACLE["user_segmentation"] = q(COHORT + """
SELECT user_type, count(user_id) AS total_users,
       count(user_id) * 100.0::DOUBLE / sum(count(user_id)) OVER () AS pct_of_all_users
FROM cohort GROUP BY ALL
""")

SECTION_EVENTS = f"""
, section AS (
  SELECT e.*, c.user_type, CAST(strftime(make_timestamp(e.event_timestamp), '%U') AS BIGINT) AS week_num
  FROM ev e JOIN cohort c ON c.user_id = e.user_id
  WHERE e.{IN_RANGE} AND e.{SECTION}
)"""

ORACLE["lobby_funnel_weekly"] = q(COHORT + SECTION_EVENTS + """
, weekly_sessions AS (
  SELECT user_type, week_num, user_id || '-' || session_id::VARCHAR AS sk,
         bool_or(event_name = 'dynamic_content')::INTEGER AS clicked,
         bool_or(event_name = 'gameplay_initiated')::INTEGER AS played
  FROM section GROUP BY ALL
), t AS (
  SELECT week_num, user_type, count(*) AS n, sum(clicked)::BIGINT AS c, sum(played)::BIGINT AS g
  FROM weekly_sessions GROUP BY ALL
)
SELECT week_num, user_type, n AS total_casino_sessions, c AS sessions_banner_clicked,
       round(100.0::DOUBLE * c / nullif(n, 0), 2) AS pct_sessions_clicked_banner,
       g AS sessions_gameplay_initiated,
       round(100.0::DOUBLE * g / nullif(n, 0), 2) AS pct_sessions_gameplay,
       round(100.0::DOUBLE * g / nullif(c + 1, 0), 2) AS gameplay_rate_among_banner_clickers
FROM t
""")

ORACLE["carousel_friction"] = q(COHORT + SECTION_EVENTS + """
, weekly_sessions AS (
  SELECT user_type, week_num, user_id || '-' || session_id::VARCHAR AS sk,
         bool_or(event_name IN ('menu_click', 'carousel_next', 'carousel_prev')) AS carousel,
         bool_or(event_name = 'gameplay_initiated')::INTEGER AS played
  FROM section GROUP BY ALL
), t AS (
  SELECT week_num, user_type,
         CASE WHEN carousel THEN 'With Carousel Interaction' ELSE 'No Carousel Interaction' END AS carousel_engagement,
         count(*) AS session_count, sum(played)::BIGINT AS sessions_with_gameplay,
         round(100.0::DOUBLE * sum(played) / count(*), 2) AS gameplay_conversion_pct
  FROM weekly_sessions GROUP BY ALL
)
SELECT *, row_number() OVER (PARTITION BY week_num, user_type
                             ORDER BY gameplay_conversion_pct DESC, carousel_engagement) AS conversion_rank
FROM t
""")

ORACLE["clicker_deposit_conversion"] = q(COHORT + f"""
, clickers AS (
  SELECT DISTINCT user_id FROM ev
  WHERE {IN_RANGE} AND event_name = 'dynamic_content' AND {SECTION} AND user_id IS NOT NULL
), others AS (
  SELECT user_id FROM ev WHERE {IN_RANGE} AND {SECTION} AND user_id IS NOT NULL
  EXCEPT
  SELECT user_id FROM clickers
), depositors AS (
  SELECT DISTINCT user_id FROM ev WHERE {IN_RANGE} AND event_name = 'deposit_success'
), grouped AS (
  SELECT 'BANNER_CLICKER' AS group_type, user_id FROM clickers
  UNION ALL
  SELECT 'NON_CLICKER', user_id FROM others
)
SELECT c.user_type, g.group_type, count(*) AS total_users,
       count(*) FILTER (WHERE g.user_id IN (SELECT user_id FROM depositors)) AS users_deposited,
       round(100.0::DOUBLE * count(*) FILTER (WHERE g.user_id IN (SELECT user_id FROM depositors)) / count(*), 2)
         AS deposit_conversion_rate_pct
FROM grouped g JOIN cohort c USING (user_id)
GROUP BY ALL
""")

ORACLE["daily_trend_moving_avg"] = q(COHORT + f"""
, daily AS (
  SELECT CAST(make_timestamp(e.event_timestamp) AS DATE) AS activity_date, c.user_type,
         count(DISTINCT e.user_id || '-' || e.session_id::VARCHAR) AS total_casino_sessions,
         count(*) FILTER (WHERE e.event_name = 'dynamic_content') AS banner_clicks,
         count(*) FILTER (WHERE e.event_name = 'gameplay_initiated') AS gameplay_initiations,
         count(*) FILTER (WHERE e.event_name = 'deposit_success') AS deposits
  FROM ev e JOIN cohort c ON c.user_id = e.user_id
  WHERE e.{IN_RANGE} AND e.{SECTION}
  GROUP BY ALL
)
SELECT activity_date, user_type, total_casino_sessions, banner_clicks,
       round(100.0::DOUBLE * banner_clicks / nullif(total_casino_sessions, 0), 2) AS banner_click_rate_pct,
       gameplay_initiations,
       round(100.0::DOUBLE * gameplay_initiations / nullif(total_casino_sessions, 0), 2) AS gameplay_rate_pct,
       deposits,
       avg(100.0::DOUBLE * gameplay_initiations / nullif(total_casino_sessions, 0))
         OVER (PARTITION BY user_type ORDER BY activity_date ROWS 6 PRECEDING) AS gameplay_rate_7day_ma
FROM daily
""")

LOGIN = f"""
, login AS (
  SELECT user_id, min(event_timestamp) AS t_login
  FROM ev WHERE {IN_RANGE} AND event_name = 'login_success' AND user_id IS NOT NULL GROUP BY user_id
)"""


def first_time(t: str) -> str:
    return (f"CASE WHEN {t} BETWEEN l.t_login AND l.t_login + {DAY_US} THEN 'FIRST-TIME' "
            f"ELSE 'RETURNING' END")


ORACLE["banner_return_vs_gameplay_weekly"] = q(LOGIN + f"""
, sect AS (
  SELECT user_id, session_id, event_name, event_date, make_timestamp(event_timestamp) AS ts,
         event_timestamp AS t
  FROM ev WHERE {IN_RANGE} AND {SECTION}
), labelled AS (
  SELECT s.*, {first_time('s.t')} AS user_type FROM sect s LEFT JOIN login l ON l.user_id = s.user_id
), clicks AS (
  SELECT DISTINCT user_id, session_id, ts AS click_ts, ts + INTERVAL 1 SECOND AS from_ts, user_type
  FROM labelled WHERE event_name = 'dynamic_content'
), next_visit AS (          -- first section event of the same user at least one whole second later
  SELECT c.*, v.ts AS next_ts
  FROM clicks c ASOF LEFT JOIN sect v ON c.user_id = v.user_id AND c.from_ts <= v.ts
), clicked_sessions AS (
  SELECT DISTINCT user_id AS cu, session_id AS cs FROM sect WHERE event_name = 'dynamic_content'
), played_sessions AS (
  SELECT DISTINCT user_id AS pu, session_id AS ps FROM ev WHERE {IN_RANGE} AND event_name = 'gameplay_initiated'
), quiet AS (
  SELECT DISTINCT l.user_id, l.session_id, strptime(l.event_date, '%Y%m%d')::DATE AS d, l.user_type
  FROM labelled l LEFT JOIN clicked_sessions k ON k.cu = l.user_id AND k.cs = l.session_id
  WHERE k.cu IS NULL
), quiet_played AS (
  SELECT q.*, (p.pu IS NOT NULL)::INTEGER AS played
  FROM quiet q LEFT JOIN played_sessions p ON p.pu = q.user_id AND p.ps = q.session_id
)
SELECT strftime(CAST(click_ts AS DATE) - dayofweek(CAST(click_ts AS DATE))::INTEGER, '%Y-%m-%d') AS week_start,
       user_type, 'BANNER_CLICKERS' AS group_type,
       count(DISTINCT session_id) AS sessions, count(DISTINCT user_id) AS unique_users,
       count(*) FILTER (WHERE date_sub('second', click_ts, next_ts) <= 300) AS key_metric,
       round(100 * count(*) FILTER (WHERE date_sub('second', click_ts, next_ts) <= 300)
             / nullif(count(DISTINCT session_id), 0), 2) AS engagement_rate_pct  -- no session id: NULL
FROM next_visit GROUP BY ALL
UNION ALL
SELECT strftime(d - dayofweek(d)::INTEGER, '%Y-%m-%d'), user_type, 'NON_CLICKERS',
       count(DISTINCT session_id), count(DISTINCT user_id), sum(played)::BIGINT,
       round(100 * sum(played) / nullif(count(DISTINCT session_id), 0), 2)
FROM quiet_played GROUP BY ALL
""")

ORACLE["lobby_bounce_rate"] = q(LOGIN + f"""
, sess AS (
  SELECT user_id, session_id, count(*) AS n, min(event_timestamp) AS t_start
  FROM ev WHERE {IN_RANGE} AND {SECTION} AND session_id IS NOT NULL
  GROUP BY user_id, session_id
), labelled AS (
  SELECT s.*, {first_time('s.t_start')} AS user_type FROM sess s LEFT JOIN login l ON l.user_id = s.user_id
)""" + nearest_rank("labelled", "user_type", "n", 0.5, "med") + """
SELECT b.user_type, count(DISTINCT b.session_id) AS total_sessions, count(DISTINCT b.user_id) AS unique_users,
       count(*) FILTER (WHERE b.n <= 2) AS low_engagement_sessions,
       round(100 * count(*) FILTER (WHERE b.n <= 2) / nullif(count(DISTINCT b.session_id), 0), 2)
         AS bounce_rate_pct,
       round(avg(b.n), 2) AS avg_events_per_session,
       round(any_value(m.v)::DOUBLE, 2) AS median_events_per_session
FROM labelled b LEFT JOIN med m ON m.user_type = b.user_type
GROUP BY b.user_type
""")

ORACLE["page_category_breakdown"] = q(f"""
, hits AS (
  SELECT user_id, page_location AS url, count(*) AS n
  FROM ev WHERE {IN_RANGE} AND user_id IS NOT NULL AND page_location IS NOT NULL
  GROUP BY ALL
), labelled AS (
  SELECT *,
    CASE
      WHEN url LIKE '{HOME}/' OR url LIKE '{HOME}/tr' OR url LIKE '{HOME}/en' THEN 'Home'
      WHEN url LIKE '%/canli-casino%' THEN 'Live Casino'
      WHEN url LIKE '%/casino%' THEN 'Casino'
      WHEN url LIKE '%/bahis%' OR url LIKE '%/sportsbook%' THEN 'Sportsbook'
      WHEN url LIKE '%/canli-bahis%' THEN 'Live Betting'
      WHEN url LIKE '%/virtual-football%' OR url LIKE '%/oyun-penceresi%' OR url LIKE '%/game-iframe%'
        THEN 'Virtual Sports'
      WHEN url LIKE '%/account%' OR url LIKE '%modal:deposit%' OR url LIKE '%modal:pending-withdrawals%'
        THEN 'Account'
      WHEN url LIKE '%/destek%' OR url LIKE '%/support%' THEN 'Support'
      WHEN url LIKE '%/kampanyalar%' OR url LIKE '%bonus%' THEN 'Promotions'
      WHEN url LIKE '%/kayit-ol%' THEN 'Registration'
      WHEN url LIKE '%/login%' OR url LIKE '%session_expired%' THEN 'Login/Session'
      ELSE 'Other'
    END AS page_category
  FROM hits
)
SELECT page_category, count(DISTINCT url) AS unique_pages, sum(n)::BIGINT AS total_page_views,
       count(DISTINCT user_id) AS unique_users_in_category,
       round(100 * sum(n) / sum(sum(n)) OVER (), 1) AS percent_of_all_page_views
FROM labelled GROUP BY ALL
""")

PAY_COHORT = f"""
, known AS (
  SELECT user_id AS player_id,
         CASE WHEN min(event_timestamp) < {CUT_US} THEN 'RETURNING_USER' ELSE 'NEW_USER' END AS user_type
  FROM ev WHERE {IN_RANGE} AND user_id IS NOT NULL GROUP BY user_id
)"""


def paid(extra: str = "") -> str:
    """CTE ``paid``: successful payments of the unit in the window, amount in
    integer cents, joined to the cohort (players without events drop out)."""
    return f"""
, paid AS (
  SELECT p.player_id, k.user_type, CAST(CAST(p.date_created AS TIMESTAMP) AS DATE) AS deposit_date,
         CAST(round(p."transaction_amount_EUR" * 100) AS HUGEINT) AS cents
  FROM pay p JOIN known k ON k.player_id = p.player_id
  WHERE CAST(CAST(p.date_created AS TIMESTAMP) AS DATE) BETWEEN DATE '2023-12-31' AND DATE '2024-01-31'
    AND p.business_unit_name = 'SITE_A' AND p.payment_status IN ('CAPTURED', 'COMPLETED'){extra}
)"""


ORACLE["deposits_by_cohort_per_user"] = q(PAY_COHORT + paid() + """
, per_player AS (   -- mean per player in 1e-12 EUR, rounded half up
  SELECT deposit_date, user_type, player_id, count(*) AS k, sum(cents) AS cents,
         (2 * sum(cents) * 10000000000 + count(*)) // (2 * count(*)) AS mean_e12
  FROM paid GROUP BY ALL
), per_day AS (     -- mean of means in 1e-16 EUR, rounded half up
  SELECT deposit_date, user_type, count(*) AS users_deposited, round(avg(k), 3) AS avg_transactions_per_user,
         (2 * sum(mean_e12) * 10000 + count(*)) // (2 * count(*)) AS mean_e16, sum(cents) AS cents
  FROM per_player GROUP BY ALL
)
SELECT deposit_date, user_type, users_deposited, avg_transactions_per_user,
       ((2 * mean_e16 + 100000000000000) // 200000000000000)::DOUBLE / 100 AS avg_amount_per_user,
       cents::DOUBLE / 100 AS total_revenue
FROM per_day
""")

ORACLE["deposit_amount_stats_by_cohort"] = q(PAY_COHORT + paid(' AND p."transaction_amount_EUR" > 0') + """
SELECT deposit_date, user_type, count(DISTINCT player_id) AS unique_depositors,
       count(*) AS total_deposit_transactions,
       ((2 * sum(cents) + count(*)) // (2 * count(*)))::DOUBLE / 100 AS "avg_deposit_amount_EUR",
       sum(cents)::DOUBLE / 100 AS "total_deposited_EUR",
       min(cents)::DOUBLE / 100 AS "min_amount_EUR",
       max(cents)::DOUBLE / 100 AS "max_amount_EUR",
       round(stddev_samp(cents::DOUBLE / 100), 2) AS "stddev_amount_EUR"
FROM paid GROUP BY ALL
""")

ORACLE["tracking_outages"] = daily_kpi("user_id") + """
, marked AS (
  SELECT *, sessions > 0 AND coalesce(gameplay_anytime_rate, 0) = 0 AND coalesce(promo_click_rate, 0) = 0
              AND coalesce(deposit_window_rate, 0) = 0 AND coalesce(deposit_initiated_rate, 0) = 0
              AND coalesce(deposit_success_rate, 0) = 0 AS is_outage
  FROM daily
), breaks AS (
  SELECT *, CASE WHEN lag(activity_date) OVER w = activity_date - 1 AND lag(is_outage) OVER w = is_outage
                 THEN 0 ELSE 1 END AS new_run
  FROM marked WINDOW w AS (PARTITION BY operating_system, user_type ORDER BY activity_date)
), runs AS (
  SELECT *, sum(new_run) OVER (PARTITION BY operating_system, user_type ORDER BY activity_date) AS run_id
  FROM breaks
)
SELECT operating_system, user_type, run_id::BIGINT AS run_id, is_outage,
       min(activity_date) AS run_start, max(activity_date) AS run_end, count(*) AS run_days,
       sum(sessions)::BIGINT AS sessions
FROM runs GROUP BY ALL
"""

ORACLE["deposit_period_comparison"] = q(PAY_COHORT + paid(' AND p."transaction_amount_EUR" > 0') + """
, labelled AS (
  SELECT *, CASE WHEN deposit_date BETWEEN DATE '2023-12-31' AND DATE '2024-01-08' THEN '1_baseline'
                 WHEN deposit_date BETWEEN DATE '2024-01-09' AND DATE '2024-01-19' THEN '2_onset'
                 WHEN deposit_date BETWEEN DATE '2024-01-20' AND DATE '2024-01-31' THEN '3_full' END AS period
  FROM paid
)
SELECT period, user_type, count(DISTINCT player_id) AS depositors, count(*) AS transactions,
       ((2 * sum(cents) + count(*)) // (2 * count(*)))::DOUBLE / 100 AS "avg_deposit_amount_EUR",
       sum(cents)::DOUBLE / 100 AS "total_deposited_EUR"
FROM labelled WHERE period IS NOT NULL GROUP BY ALL
""")

# Days in both results; the correlation over two rounded columns, to 9 decimals.
ORACLE["deposit_vs_banner_correlation"] = f"""
SELECT d.user_type, count(*) AS days,
       round(covar_pop(d."avg_deposit_amount_EUR", b.banner_click_rate_pct)
             / nullif(stddev_pop(d."avg_deposit_amount_EUR") * stddev_pop(b.banner_click_rate_pct), 0), 9) AS corr_amount_vs_click_rate
FROM ({ORACLE["deposit_amount_stats_by_cohort"]}) d
JOIN ({ORACLE["daily_trend_moving_avg"]}) b ON b.activity_date = d.deposit_date AND b.user_type = d.user_type
GROUP BY d.user_type
"""
