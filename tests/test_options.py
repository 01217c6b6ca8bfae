"""Optional variants (approximate distincts, session identity, corrected rate)
and the CSV sink."""

import csv
import glob
import os
import random
import tempfile

from pyspark.sql import functions as F

from eventlens import plans
from eventlens.operators import NOT_KEYED, lobby_session_rollup
from eventlens.sources import write_csv
from tests.helpers import ALL, S, T0, ev, events_df

SECTION = "https://a.example.com/tr/casino/x"


def test_approx_distinct_close_to_exact(spark):
    rows = [ev(f"u{i % 50}", T0 + i * S, session=i % 200) for i in range(400)]
    df = events_df(spark, rows)
    exact = plans.lobby_volume_by_host_platform(df, *ALL).first()
    approx = plans.lobby_volume_by_host_platform(df, *ALL, approx_rsd=0.02).first()
    assert abs(approx.sessions - exact.sessions) <= 0.1 * exact.sessions
    assert abs(approx.users - exact.users) <= 0.1 * exact.users


def test_weekly_by_identity_keeps_sessions_apart(spark):
    rows = [ev("u1", T0, session=1), ev("u2", T0, session=2)]   # same start microsecond
    df = events_df(spark, rows)
    merged = plans.weekly_lobby_kpi(df, *ALL).first().sessions
    apart = plans.weekly_lobby_kpi(df, *ALL, by_identity=True).first().sessions
    assert (merged, apart) == (1, 2)


def test_corrected_clicker_rate(spark):
    rows = [ev("u1", T0, "dynamic_content", session=1, pl=SECTION),
            ev("u1", T0 + S, "gameplay_initiated", session=1, pl=SECTION),
            ev("u2", T0, "dynamic_content", session=2, pl=SECTION),
            ev("u3", T0, "gameplay_initiated", session=3, pl=SECTION)]
    r = plans.lobby_funnel_weekly(events_df(spark, rows), *ALL, *ALL, "2099-01-01", corrected=True).first()
    assert r.sessions_banner_clicked == 2 and r.sessions_gameplay_initiated == 2
    assert r.gameplay_rate_among_banner_clickers == round(100.0 * 2 / 3, 2)
    assert r.gameplay_pct_of_clicked_sessions == 50.0


def test_csv_sink_header_and_null(spark):
    df = spark.createDataFrame([("a", None), (None, 1)], "k string, v long")
    out = tempfile.mkdtemp(prefix="eventlens-csv-", dir=os.environ.get("EVENTLENS_SCRATCH", "/tmp"))
    write_csv(df.coalesce(1), out + "/r")
    (part,) = glob.glob(out + "/r/part-*.csv")
    with open(part) as f:
        assert list(csv.reader(f)) == [["k", "v"], ["a", ""], ["", "1"]]


def _model(rows):
    """Join-back form in plain Python: lobby sessions, then all events with the
    same non-NULL (user, session)."""
    lobby = {}
    for r in rows:
        pl = dict((p["key"], p["value"]["string_value"]) for p in r["event_params"]).get("page_location")
        if r["event_name"] == "page_view" and pl and pl.endswith("/tr/casino"):
            key = (r["user_id"], dict((p["key"], p["value"]["int_value"]) for p in r["event_params"]).get("ga_session_id"))
            lobby.setdefault(key, []).append(r["event_timestamp"])
    out = {}
    for (u, s), ts in lobby.items():
        evs = [] if u is None or s is None else [
            r for r in rows if r["user_id"] == u
            and dict((p["key"], p["value"]["int_value"]) for p in r["event_params"]).get("ga_session_id") == s]
        games = [r["event_timestamp"] for r in evs if r["event_name"] == "gameplay_initiated"]
        out[(u, s)] = (min(ts), min(games) if games else None, len(games),
                       int(any(r["event_name"] == "scroll" for r in evs)))
    return out


def test_rollup_equals_join_back_model(spark):
    for seed in range(3):
        rnd = random.Random(seed)
        rows = []
        for i in range(200):
            name = rnd.choice(["page_view", "page_view", "gameplay_initiated", "scroll", "menu_click"])
            pl = rnd.choice(["https://h/tr/casino", "https://h/tr/bahis", None])
            rows.append(ev(rnd.choice(["a", "b", "c", None]), T0 + rnd.randrange(0, 10_000) * S, name,
                           session=rnd.choice([1, 2, 3, None]), pl=pl))
        df = events_df(spark, rows).select(
            "user_id", "event_name", "event_timestamp",
            F.get(F.filter("event_params", lambda p: p["key"] == "ga_session_id"), 0)["value"]["int_value"].alias("session_id"),
            F.get(F.filter("event_params", lambda p: p["key"] == "page_location"), 0)["value"]["string_value"].alias("pl"))
        lobby = (F.col("event_name") == "page_view") & F.col("pl").rlike(r"/tr/casino\z")
        got = lobby_session_rollup(df, lobby, metrics={
            "first_game": ("min", F.when(F.col("event_name") == "gameplay_initiated", F.col("event_timestamp")), NOT_KEYED),
            "games": ("count_if", F.col("event_name") == "gameplay_initiated", 0),
            "scrolled": ("max", F.when(F.col("event_name") == "scroll", 1).otherwise(0), 0)}).collect()
        got = {(r.user_id, r.session_id): (r.lobby_first_ts, r.first_game, r.games, r.scrolled) for r in got}
        assert got == _model(rows)
