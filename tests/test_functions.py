"""Column helpers: parameter lookup, predicates, time helpers."""

import datetime as dt

from pyspark.sql import functions as F

from eventlens.functions import (
    host_of, identity_key, in_section, lobby_path_variant, lobby_root, lobby_root_any_locale,
    page_category, param_int, param_str, secs_between, user_type_by_session_number, utc_date,
    week_monday, week_num_sunday, week_sunday)
from tests.helpers import T0, ev, events_df


def pl():
    return param_str("page_location")


def one(spark, col, rows=None):
    df = events_df(spark, rows or [ev()])
    return [r[0] for r in df.select(col).collect()]


def test_param_lookup_slots_missing_duplicate_empty_null(spark):
    rows = [
        ev(),
        ev(params={"ga_session_id": None}),
        ev(raw_params=[{"key": "ga_session_id", "value": {"string_value": None, "int_value": 7}},
                       {"key": "ga_session_id", "value": {"string_value": None, "int_value": 8}}]),
        ev(raw_params=[]),
        ev(raw_params=None) | {"event_params": None},
    ]
    got = one(spark, param_int("ga_session_id"), rows)
    assert got == [1, None, 7, None, None]           # H20: first of a repeated key
    # wrong slot yields NULL, not an error
    assert one(spark, param_str("ga_session_id")) == [None]
    assert one(spark, param_str("page_location")) == ["https://a.example.com/tr/casino"]


def test_lobby_predicates_h5(spark):
    urls = ["https://h/tr/casino", "https://h/tr/casino/", "https://h/tr/casino?x=1",
            "https://h/tr/casino/slots/1", "https://h/xx/casino", "https://h/casino", "https://h/tr/casino\n",
            None]
    rows = [ev(pl=u) for u in urls]
    assert one(spark, lobby_root(pl()), rows) == [True, True, True, False, False, False, False, None]
    assert one(spark, lobby_root_any_locale(pl()), rows) == [
        True, True, True, False, True, True, False, None]
    assert one(spark, in_section(pl()), rows) == [False, True, False, True, False, False, False, None]
    assert one(spark, lobby_path_variant(pl()), rows) == [
        "tr/casino", "tr/casino", "tr/casino", "other", "casino", "casino", "other", "other"]


def test_host_extraction_f2(spark):
    urls = ["https://a.b.com/x", "http://h:8080/p", "https://nohost", "a.com/x", "https://h/"]
    rows = [ev(pl=u) for u in urls]
    assert one(spark, host_of(pl()), rows) == ["a.b.com", "h:8080", None, None, "h"]


def test_page_category_order_h18(spark):
    urls = ["https://site1.com/", "https://site1.com/tr", "https://site1.com/tr/canli-casino/x",
            "https://site1.com/tr/casino/x", "https://x.com/tr/bahis/1", "https://x.com/tr/canli-bahis",
            "https://x.com/tr/account/2", "https://x.com/?modal:deposit", "https://x.com/tr/destek",
            "https://x.com/bonus", "https://x.com/tr/kayit-ol", "https://x.com/tr/login", "https://x.com/blog",
            "https://x.com/"]
    rows = [ev(pl=u) for u in urls]
    assert one(spark, page_category("https://site%.com", pl()), rows) == [
        "Home", "Home", "Live Casino", "Casino", "Sportsbook", "Live Betting", "Account", "Account", "Support",
        "Promotions", "Registration", "Login/Session", "Other", "Other"]


def test_weeks_h6(spark):
    days = ["2025-11-02", "2025-11-03", "2026-01-01", "2026-01-04", "2025-12-31"]
    df = spark.createDataFrame([(d,) for d in days], "d string").select(F.to_date("d").alias("d"))
    got = df.select(week_monday("d").cast("string"), week_sunday("d").cast("string"), week_num_sunday("d")).collect()
    assert [tuple(r) for r in got] == [
        ("2025-10-27", "2025-11-02", 44), ("2025-11-03", "2025-11-02", 44),
        ("2025-12-29", "2025-12-28", 0), ("2025-12-29", "2026-01-04", 1), ("2025-12-29", "2025-12-28", 52)]
    for d in days:
        want = int(dt.date.fromisoformat(d).strftime("%U"))
        got = df.filter(F.col("d") == F.lit(d).cast("date")).select(week_num_sunday("d")).first()[0]
        assert got == want


def test_utc_date_independent_of_session_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        ts = T0 - 13 * 3600 * 1_000_000   # 2025-11-02 23:00 UTC
        assert one(spark, utc_date(F.lit(ts)).cast("string")) == ["2025-11-02"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_seconds(spark):
    df = spark.createDataFrame([(0, 1_500_000), (0, -1_500_000), (0, 999_999), (None, 5)], "a long, b long")
    got = df.select(secs_between("b", "a")).collect()
    assert [r[0] for r in got] == [1.5, -1.5, 0.999999, None]


def test_identity_and_user_type(spark):
    df = spark.createDataFrame([("", None, "s", "u"), (None, "", "", "u"), ("e", "c", "s", None),
                                ("", "", "", None)], "a string, b string, c string, u string")
    assert [r[0] for r in df.select(identity_key("a", "b", "c", "u")).collect()] == ["s", "u", "e", None]
    df = spark.createDataFrame([(1,), (2,), (None,)], "n long")
    assert [r[0] for r in df.select(user_type_by_session_number("n")).collect()] == [
        "NEW_USER", "RETURNING_USER", "RETURNING_USER"]
