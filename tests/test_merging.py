"""Mergeable distinct counts (bitmaps) and quantiles (sketches)."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from eventlens import plans
from eventlens.plans import distinct_states as D
from eventlens.plans import quantile_states as Q
from eventlens.plans import volume
from eventlens.sources.fixtures import load_fixture, load_states
from tests.helpers import ALL, S, T0, ev, events_df

SF = "/root/testdata/sf0.001"
DAY = 86_400 * S


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def some_events(seed):
    rnd = random.Random(seed)
    out = [ev(rnd.choice(["a", "b", "c", None, "d"]), T0 + rnd.randrange(0, 3) * DAY + rnd.randrange(1000) * S, "page_view",
              session=rnd.choice([1, 2, 3, None]), os_=rnd.choice(["iOS", "Android"]), platform=rnd.choice(["WEB", "APP"]),
              pl=rnd.choice(["https://x/tr/casino", "https://y/tr/casino", "https://x/casino"]),
              params={"brand": rnd.choice(["p", None])}) for _ in range(150)]
    return out + [ev(None, T0, "page_view", session=9, pl="https://nobody/tr/casino")]   # a group without a user


CASES = [(volume.host_platform_rows, volume.HOST_PLATFORM, plans.lobby_volume_by_host_platform),
         (volume.device_rows, volume.DEVICE, plans.lobby_volume_by_device),
         (volume.url_variant_rows, volume.URL_VARIANT, plans.lobby_sessions_by_url_variant)]


@pytest.mark.parametrize("make, keys, analysis", CASES)
def test_days_added_one_by_one_equal_the_analysis(spark, tmp_path, make, keys, analysis):
    df = events_df(spark, some_events(1))
    days = sorted(r[0] for r in df.select("event_date").distinct().collect())
    assert len(days) == 3
    numbers, states = str(tmp_path / "n"), str(tmp_path / "s")
    given = {}
    for day in (*days, days[1]):
        part = make(df, day, day)
        D.add_numbers(part, numbers)
        known = {(r.kind, r.key): r.n for r in D.read_numbers(spark, numbers).collect()}
        assert given.items() <= known.items()      # numbers never change
        given = known
        D.write_distinct_states(D.distinct_states(part, keys, D.read_numbers(spark, numbers)), states)
    for kind in (D.USER, D.SESSION):
        n = sorted(v for (k, _), v in given.items() if k == kind)
        assert n == list(range(1, len(n) + 1))      # dense
    stored = D.read_distinct_states(spark, states, keys)
    for lo, hi in ((days[0], days[2]), (days[1], days[2]), (days[1], days[1])):
        got = D.sessions_and_users(stored, lo, hi, keys).select(*keys, "sessions", "users")
        assert rows(got) == rows(analysis(df, lo, hi).select(*keys, "sessions", "users"))


def test_a_key_without_number_is_refused(spark):
    part = volume.host_platform_rows(events_df(spark, some_events(2)), *ALL)
    with pytest.raises(Exception, match="no number for"):
        D.distinct_states(part, volume.HOST_PLATFORM, spark.createDataFrame([], D.NUMBERS)).collect()


@pytest.mark.parametrize("name", [n for n in E.STORED if n.endswith("_from_bitmaps")])
def test_bitmap_queries_shuffle_groups_times_buckets(spark, name):
    df = E.queries()[name](spark, SF)
    assert rows(df) == rows(E.queries()[name.removesuffix("_from_bitmaps")](spark, SF))
    keys = [line.split("hashpartitioning(")[1] for line in df._jdf.queryExecution().executedPlan().toString().splitlines()
            if "Exchange hashpartitioning(" in line]
    assert keys and all("user_id" not in k and "session_id" not in k for k in keys)


def test_numbers_over_many_buckets(spark):
    """More keys than one bitmap holds."""
    many = spark.range(100_000).select(F.lit("20250101").alias("event_date"), F.lit("h").alias("host"), F.lit("WEB").alias("platform"),
                                       F.concat(F.lit("u"), F.col("id") % 70_000).alias("user_id"), F.col("id").alias("session_id"))
    numbers = D.numbered(D.keys_of(many), spark.createDataFrame([], D.NUMBERS))
    states = D.distinct_states(many, volume.HOST_PLATFORM, numbers)
    assert states.count() <= 4 + 3 + 2
    assert rows(D.sessions_and_users(states, *ALL, volume.HOST_PLATFORM)) == [("h", "WEB", 100_000, 70_000)]


def test_quantile_rank_error_on_a_million_values(spark):
    """Sketches of forty days, merged: within the stated bound."""
    n = 1_000_000
    values = spark.range(n).select((F.col("id") % 40).alias("day"), F.pow(F.pmod(F.col("id") * 7919, F.lit(n)) / F.lit(float(n)), 3).alias("x"))
    for k in (200, Q.K):
        daily = values.groupBy("day").agg(F.kll_sketch_agg_double("x", k).alias("sketch"))
        merged = daily.agg(F.kll_merge_agg_double("sketch", k).alias("s"))
        for p in (0.5, 0.75):
            x = merged.select(F.kll_sketch_get_quantile_double("s", F.lit(p))).first()[0]
            assert abs(x ** (1 / 3) - p) <= Q.rank_error(k) + 1e-6
    assert Q.rank_error(200) < 0.02 and Q.rank_error() < 0.0013


def test_merged_sketches_equal_nearest_ranks_of_small_groups(spark):
    events, _ = load_fixture(spark, SF)
    names = ["user_type", "operating_system", "lobby_sessions", "median_time_to_first_gameplay_sec", "p75_time_to_first_gameplay_sec"]
    want = rows(E.queries()["lobby_session_baseline"](spark, SF).select(*names))
    assert rows(E.queries()["time_to_game_quantiles_from_sketches"](spark, SF).select(*names)) == want
    for source in (events, load_states(spark, SF)):
        daily = Q.time_to_game_sketches(source, "20231231", "20240131")
        assert rows(Q.time_to_game_quantiles(daily, "2023-12-01", "2024-02-28").select(*names)) == want


def test_quantiles_without_any_game(spark):
    df = events_df(spark, [ev("a", T0, "page_view", session=1), ev("b", T0 + DAY, "page_view", session=2)])
    got = Q.time_to_game_quantiles(Q.time_to_game_sketches(df, *ALL), "2025-01-01", "2026-01-01").collect()
    assert [(r.lobby_sessions, r.median_time_to_first_gameplay_sec) for r in got] == [(2, None)]
