"""Lobby volume analyses (Q01-Q06, Q08, Q10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from eventlens.functions.identity import identity_key, user_type_by_session_number
from eventlens.functions.params import param_int, param_str
from eventlens.functions.predicates import (
    host_of, lobby_path_variant, lobby_root, lobby_root_any_locale, mobile_or_tablet)
from eventlens.plans.common import BANNER, PAGE_VIEW, flag, scan, session_key
from eventlens.sources.events import shard_range


def _distinct(col, rsd):
    """Exact ``COUNT(DISTINCT)`` or, with ``rsd``, HyperLogLog++ with that
    relative standard deviation (mergeable, no shuffle of the distinct values)."""
    return F.count_distinct(col) if rsd is None else F.approx_count_distinct(col, rsd)


def _sessions_and_users(ev: DataFrame, keys: list[str], rsd: float | None) -> DataFrame:
    """Distinct (user, session) pairs and users per group.  Exact: pairs are
    made distinct first, then counted per user, then summed, so no row is
    multiplied for two distinct counts.  A pair without a user is no session
    (the source's CONCAT is NULL)."""
    if rsd is not None:
        return ev.groupBy(*keys).agg(_distinct(session_key(), rsd).alias("sessions"),
                                     _distinct(F.col("user_id"), rsd).alias("users"))
    per_user = ev.select(*keys, "user_id", "session_id").distinct().groupBy(*keys, "user_id").agg(
        F.count("session_id").alias("_n"))
    known = F.col("user_id").isNotNull()
    return per_user.groupBy(*keys).agg(F.coalesce(F.sum(F.when(known, F.col("_n"))), F.lit(0)).alias("sessions"),
                                       F.count("user_id").alias("users"))


#: Grouping columns of the volume analyses; ``*_rows`` give these, the shard
#: date, the user and the session of each event that counts.
HOST_PLATFORM = ["host", "platform"]
DEVICE = ["host", "brand", "platform", "device_category", "operating_system"]
URL_VARIANT = ["host", "brand", "lobby_path_variant", "operating_system"]


def host_platform_rows(events: DataFrame, date_from: str, date_to: str, lobby_path: str = "/tr/casino") -> DataFrame:
    ev = scan(events, date_from, date_to, ["ga_session_id", "page_location"],
              ["user_id", "event_name", "platform", "event_date"])
    ev = ev.filter((F.col("event_name") == PAGE_VIEW) & F.col("session_id").isNotNull()
                   & lobby_root("page_location", lobby_path))
    return ev.select("event_date", "user_id", "session_id", "platform", host_of("page_location").alias("host"))


def lobby_volume_by_host_platform(events: DataFrame, date_from: str, date_to: str,
                                  lobby_path: str = "/tr/casino",
                                  approx_rsd: float | None = None) -> DataFrame:
    """Q01: lobby-root sessions and users per host and platform."""
    out = _sessions_and_users(host_platform_rows(events, date_from, date_to, lobby_path), HOST_PLATFORM, approx_rsd)
    return out.orderBy(F.desc("sessions"), *HOST_PLATFORM)


def param_inventory_in_lobby_sessions(events: DataFrame, date_from: str, date_to: str,
                                      lobby_path: str = "/tr/casino",
                                      event_name: str = BANNER) -> DataFrame:
    """Q02: parameter keys on banner events of sessions that saw the lobby.

    One scan: every banner event contributes its parameter keys and every
    lobby page view a marker row, pre-aggregated per (user, session, key).
    Whether the session saw the lobby is then a window over the session's
    few pre-aggregated rows, which replaces the semi-join (no second scan,
    and a hot session is at most #keys + 1 rows after map-side combine).
    An event with an empty array contributes nothing, as the lateral join."""
    if "event_params" not in events.columns:
        raise ValueError("the parameter-key inventory needs the nested export (event_params)")
    ev = shard_range(events, date_from, date_to).filter(F.col("event_name").isin(PAGE_VIEW, event_name))
    is_lobby = (F.col("event_name") == PAGE_VIEW) & lobby_root(param_str("page_location"), lobby_path)
    rows = ev.select("user_id", param_int("ga_session_id").alias("session_id"),
                     F.coalesce(is_lobby, F.lit(False)).alias("_marker"),
                     (F.col("event_name") == event_name).alias("_banner"), "event_params")
    rows = rows.filter(F.col("user_id").isNotNull() & F.col("session_id").isNotNull()
                       & (F.col("_marker") | F.col("_banner")))
    # a row may be both (``event_name=page_view``): a marker entry and its keys
    entry = "struct<marker:boolean,key:string>"
    marker = F.when(F.col("_marker"), F.array(F.struct(F.lit(True), F.lit(None).cast("string")).cast(entry))) \
        .otherwise(F.array().cast(f"array<{entry}>"))
    own = F.when(F.col("_banner"), F.transform("event_params.key", lambda k: F.struct(F.lit(False), k).cast(entry)))
    own = F.coalesce(own, F.array().cast(f"array<{entry}>"))
    per_key = (rows.select("user_id", "session_id", F.explode(F.concat(marker, own)).alias("e"))
               .select("user_id", "session_id", F.col("e.marker").alias("_marker"), F.col("e.key").alias("param_key"))
               .groupBy("user_id", "session_id", "_marker", "param_key").agg(F.count(F.lit(1)).alias("n")))
    seen = F.max(F.col("_marker").cast("int")).over(Window.partitionBy("user_id", "session_id"))
    hit = per_key.withColumn("_seen", seen).filter((F.col("_seen") == 1) & ~F.col("_marker"))
    out = hit.groupBy("param_key").agg(F.sum("n").alias("occurrences"))
    return out.orderBy(F.desc("occurrences"), "param_key")


def device_rows(events: DataFrame, date_from: str, date_to: str, lobby_path: str = "/tr/casino") -> DataFrame:
    ev = scan(events, date_from, date_to, ["ga_session_id", "brand", "page_location"],
              ["user_id", "event_name", "platform", "device_category", "operating_system", "event_date"])
    ev = ev.filter((F.col("event_name") == PAGE_VIEW) & F.col("session_id").isNotNull()
                   & lobby_root("page_location", lobby_path))
    return ev.withColumn("host", host_of("page_location")).select("event_date", "user_id", "session_id", *DEVICE)


def lobby_volume_by_device(events: DataFrame, date_from: str, date_to: str,
                           lobby_path: str = "/tr/casino", approx_rsd: float | None = None) -> DataFrame:
    """Q03: lobby-root sessions by host, brand, platform, device category and OS."""
    out = _sessions_and_users(device_rows(events, date_from, date_to, lobby_path), DEVICE, approx_rsd)
    return out.orderBy(F.desc("sessions"), *DEVICE)


def lobby_event_inventory(events: DataFrame, date_from: str, date_to: str,
                          lobby_path: str = "/tr/casino", platform: str = "WEB") -> DataFrame:
    """Q04: events of any type on the lobby page, mobile and tablet web."""
    ev = scan(events, date_from, date_to, ["page_location"],
              ["event_name", "platform", "device_category"])
    ev = ev.filter((F.col("platform") == platform) & mobile_or_tablet("device_category")
                   & lobby_root("page_location", lobby_path))
    out = ev.groupBy("event_name").agg(F.count(F.lit(1)).alias("event_count"))
    return out.orderBy(F.desc("event_count"), "event_name")


BANNER_KEYS = ["brand", "content_type", "user_interaction", "click_target", "navigation_selection", "idx"]


def banner_combination_topk(events: DataFrame, date_from: str, date_to: str,
                            lobby_path: str = "/tr/casino", platform: str = "WEB",
                            k: int = 100) -> DataFrame:
    """Q05: top-k banner parameter combinations on the lobby page (mobile web).

    Ties on the count are broken by the grouping keys (NULLs first), so the
    cut at k is deterministic; Spark plans it as TakeOrderedAndProject."""
    ev = scan(events, date_from, date_to,
              ["brand", "content_type", "user_interaction", "click_target", "navigation_selection",
               "index", "page_location"],
              ["event_name", "platform", "device_category"])
    ev = ev.filter((F.col("event_name") == BANNER) & (F.col("platform") == platform)
                   & mobile_or_tablet("device_category") & lobby_root("page_location", lobby_path))
    out = ev.groupBy(*BANNER_KEYS).agg(F.count(F.lit(1)).alias("events"))
    return out.orderBy(F.desc("events"), *[F.asc_nulls_first(c) for c in BANNER_KEYS]).limit(k)


def url_variant_rows(events: DataFrame, date_from: str, date_to: str, locale: str = "tr", section: str = "casino") -> DataFrame:
    ev = scan(events, date_from, date_to, ["ga_session_id", "brand", "page_location"],
              ["user_id", "event_name", "device_category", "operating_system", "event_date"])
    ev = ev.filter((F.col("event_name") == PAGE_VIEW) & mobile_or_tablet("device_category")
                   & F.col("session_id").isNotNull()
                   & lobby_root_any_locale("page_location", locale, section))
    ev = ev.withColumn("host", host_of("page_location")) \
           .withColumn("lobby_path_variant", lobby_path_variant("page_location", locale, section))
    return ev.select("event_date", "user_id", "session_id", *URL_VARIANT)


def lobby_sessions_by_url_variant(events: DataFrame, date_from: str, date_to: str,
                                  locale: str = "tr", section: str = "casino",
                                  approx_rsd: float | None = None) -> DataFrame:
    """Q06: mobile lobby sessions by URL variant (with or without locale), brand, host, OS."""
    out = _sessions_and_users(url_variant_rows(events, date_from, date_to, locale, section), URL_VARIANT, approx_rsd)
    return out.orderBy(F.desc("sessions"), *URL_VARIANT)


def multi_host_exposure(events: DataFrame, date_from: str, date_to: str,
                        lobby_path: str = "/tr/casino") -> DataFrame:
    """Q08: histogram of distinct hosts per identity on mobile lobby page views.

    The identity is the first non-empty of enhancedUserId, customer_guid,
    ssguid, user_id; a NULL identity is one identity.  Distinct (identity,
    host) first, so even a hot identity shrinks to a handful of rows."""
    ev = scan(events, date_from, date_to, ["enhancedUserId", "customer_guid", "ssguid", "page_location"],
              ["user_id", "event_name", "device_category"])
    ev = ev.filter((F.col("event_name") == PAGE_VIEW) & mobile_or_tablet("device_category")
                   & lobby_root("page_location", lobby_path))
    hits = ev.select(identity_key("enhancedUserId", "customer_guid", "ssguid", "user_id").alias("identity_key"),
                     host_of("page_location").alias("host")).distinct()
    per_identity = hits.groupBy("identity_key").agg(F.count("host").alias("distinct_hosts"))
    out = per_identity.groupBy("distinct_hosts").agg(F.count(F.lit(1)).alias("identities"))
    return out.orderBy("distinct_hosts")


def identifier_coverage(events: DataFrame, date_from: str, date_to: str,
                        lobby_path: str = "/tr/casino") -> DataFrame:
    """Q10: share of mobile lobby sessions carrying each stable identifier."""
    ev = scan(events, date_from, date_to,
              ["ga_session_id", "ga_session_number", "enhancedUserId", "customer_guid", "ssguid",
               "page_location"],
              ["user_id", "event_name", "device_category", "operating_system"])
    ev = ev.filter((F.col("event_name") == PAGE_VIEW) & mobile_or_tablet("device_category")
                   & lobby_root("page_location", lobby_path))
    present = lambda c: F.max(flag(F.nullif(F.col(c), F.lit("")).isNotNull()))
    flags = ["has_enhancedUserId", "has_customer_guid", "has_ssguid"]
    # MIN(operating_system) as a grouping key first: the page views are
    # hash-aggregated (string buffers would force a sort of every row), and
    # the few (session, OS) rows are merged per session afterwards.
    per_os = ev.groupBy("user_id", "session_id", "operating_system").agg(
        F.max("ga_session_number").alias("ga_session_number"),
        present("enhancedUserId").alias(flags[0]),
        present("customer_guid").alias(flags[1]),
        present("ssguid").alias(flags[2]))
    sess = per_os.groupBy("user_id", "session_id").agg(
        F.max("ga_session_number").alias("ga_session_number"),
        F.min("operating_system").alias("operating_system"),
        *[F.max(c).alias(c) for c in flags])
    sess = sess.filter(F.col("session_id").isNotNull())
    out = sess.groupBy(user_type_by_session_number().alias("user_type"), "operating_system").agg(
        F.count(F.lit(1)).alias("lobby_sessions"),
        F.avg("has_enhancedUserId").alias("pct_sessions_with_enhancedUserId"),
        F.avg("has_customer_guid").alias("pct_sessions_with_customer_guid"),
        F.avg("has_ssguid").alias("pct_sessions_with_ssguid"))
    return out.orderBy(F.desc("lobby_sessions"), "user_type", "operating_system")
