"""Derived stores of the events: mergeable daily session states, and a table
bucketed by user."""

import random

import pytest

import __spark_entry__ as E
from eventlens import plans
from eventlens.plans.session_states import read_session_states, session_states, write_session_states
from eventlens.sources.bucketed import add_bucketed_events, create_bucketed_events, read_bucketed_events
from eventlens.sources.fixtures import load_fixture
from tests.helpers import ALL, S, T0, ev, events_df

SF = "/root/testdata/sf0.001"
DAY = 86_400 * S
NAMES = ["page_view", "page_view", "gameplay_initiated", "dynamic_content", "scroll", "deposit_window_opened", "deposit_success",
         "deposit_initiated", "search_window_initiated", "menu_click"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def random_events(seed, n=400):
    """Sessions over midnight, NULL users and sessions, several OS per session."""
    rnd = random.Random(seed)
    midnight = T0 - T0 % DAY + DAY
    out = []
    for _ in range(n):
        name = rnd.choice(NAMES)
        out.append(ev(rnd.choice(["a", "b", "c", None]), midnight + rnd.randrange(-7200, 7200) * S, name,
                      session=rnd.choice([1, 2, 3, 4, None]), os_=rnd.choice(["Android", "iOS"]),
                      pl=rnd.choice(["https://h/tr/casino", "https://h/tr/bahis", "https://h/en/casino", None]),
                      params={"navigation_selection": rnd.choice(["Promotion Area", "Hero", None]),
                              "ga_session_number": rnd.choice([1, 2, None])}))
    return out


KPI = [plans.lobby_session_baseline, plans.fast_game_start_rates, plans.weekly_lobby_kpi, plans.daily_lobby_kpi, plans.tracking_outages]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_states_equal_the_rollup_over_midnight(spark, tmp_path, seed):
    """Days are written one by one; the second day's write reads no event of the first."""
    df = events_df(spark, random_events(seed))
    days = sorted(r[0] for r in df.select("event_date").distinct().collect())
    assert len(days) == 2
    for day in days:
        write_session_states(df.filter(df.event_date == day), str(tmp_path / "s"))
    states = read_session_states(spark, str(tmp_path / "s"))
    for kpi in KPI:
        assert rows(kpi(states, *ALL)) == rows(kpi(df, *ALL)), kpi.__name__
        assert rows(kpi(states, days[1], days[1])) == rows(kpi(df, days[1], days[1])), kpi.__name__
    write_session_states(df.filter(df.event_date == days[1]), str(tmp_path / "s"))   # a day again: replaced
    states = read_session_states(spark, str(tmp_path / "s"))
    assert rows(plans.weekly_lobby_kpi(states, *ALL, by_identity=True)) == rows(plans.weekly_lobby_kpi(df, *ALL, by_identity=True))


def test_states_by_pseudo_id_and_other_lobbies(spark, tmp_path):
    df = events_df(spark, random_events(4))
    write_session_states(df, str(tmp_path / "s"), user_col="user_pseudo_id", lobby_path="/tr/bahis")
    states = read_session_states(spark, str(tmp_path / "s"), "user_pseudo_id")
    assert rows(plans.daily_lobby_kpi(states, *ALL, "/tr/bahis", "user_pseudo_id")) == \
        rows(plans.daily_lobby_kpi(df, *ALL, "/tr/bahis", "user_pseudo_id"))
    with pytest.raises(ValueError, match="not kept by"):
        plans.daily_lobby_kpi(states, *ALL, "/tr/bahis")
    with pytest.raises(Exception, match="another lobby"):
        plans.daily_lobby_kpi(states, *ALL, "/tr/casino", "user_pseudo_id").collect()
    empty = session_states(df.filter("false"))
    assert rows(plans.lobby_session_baseline(empty, *ALL)) == []


@pytest.mark.parametrize("name", sorted(E.STORED))
def test_stored_queries_equal_the_analysis(spark, name):
    base = name.rsplit("_from_", 1)[0]
    assert rows(E.queries()[name](spark, SF)) == rows(E.queries()[base](spark, SF))


@pytest.mark.parametrize("name", E.KPIS)
def test_states_are_read_instead_of_events(spark, name):
    p = plan(E.queries()[f"{name}_from_states"](spark, SF))
    assert "event_params" not in p and "PartitionFilters: [isnotnull(event_date" in p


def hash_exchanges_below_final_grouping(df):
    """Keys of the hash exchanges of a plan, lowest first, without the last one."""
    keys = [line.split("hashpartitioning(")[1] for line in plan(df).splitlines() if "Exchange hashpartitioning(" in line]
    return [k for k in keys if "session_id" in k or "user_id" in k]


@pytest.mark.parametrize("name", E.KPIS)
def test_bucketed_rollup_needs_no_exchange(spark, name):
    p = E.queries()[f"{name}_from_bucketed"](spark, SF)
    assert hash_exchanges_below_final_grouping(p) == []
    assert hash_exchanges_below_final_grouping(E.queries()[name](spark, SF))
    assert "Bucketed: true" in plan(p)


def test_bucketed_cohort_needs_no_exchange(spark):
    p = E.ANALYSES["user_segmentation"](E.load_bucketed(spark, SF), None)
    assert hash_exchanges_below_final_grouping(p) == []
    assert rows(p) == rows(E.queries()["user_segmentation"](spark, SF))


def test_bucketed_days_are_replaced_and_found_again(spark, tmp_path):
    df = events_df(spark, random_events(5))
    days = sorted(r[0] for r in df.select("event_date").distinct().collect())
    path = str(tmp_path / "b")
    create_bucketed_events(spark, "bucketed_test", path, 3)
    try:
        for day in (*days, days[0]):
            add_bucketed_events(df.filter(df.event_date == day), "bucketed_test", 3)
        assert read_bucketed_events(spark, "bucketed_test").count() == df.count()
        assert rows(plans.lobby_session_baseline(read_bucketed_events(spark, "bucketed_test"), *ALL)) == rows(plans.lobby_session_baseline(df, *ALL))
        spark.sql("DROP TABLE bucketed_test")
        create_bucketed_events(spark, "bucketed_test", path, 3)   # another session's catalog
        assert read_bucketed_events(spark, "bucketed_test").count() == df.count()
    finally:
        spark.sql("DROP TABLE IF EXISTS bucketed_test")


def test_fixture_states_match_session_rollup_rows(spark):
    """The merged states give the rollup's sessions one by one."""
    events, _ = load_fixture(spark, SF)
    a = plans.weekly_lobby_kpi(events, "20231231", "20240131", by_identity=True)
    b = plans.weekly_lobby_kpi(E.load_states(spark, SF), "20231231", "20240131", by_identity=True)
    assert rows(a) == rows(b)
