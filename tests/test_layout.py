"""Flat layout: every analysis (but the key inventory) gives the same rows."""

import os
import tempfile

import pytest

import __spark_entry__ as E
from eventlens.sources.fixtures import load_fixture
from eventlens.sources.layout import read_flat_events, write_flat_events

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    events, deposits = load_fixture(spark, SF)
    path = tempfile.mkdtemp(prefix="eventlens-flat-", dir=os.environ.get("EVENTLENS_SCRATCH", "/tmp")) + "/flat"
    write_flat_events(events, path)
    return events, deposits, read_flat_events(spark, path)


@pytest.mark.parametrize("name", sorted(set(E.ANALYSES) - E.NESTED_ONLY))
def test_flat_equals_nested(spark, tables, name):
    events, deposits, flat = tables
    a = sorted(map(tuple, E.ANALYSES[name](events, deposits).collect()), key=repr)
    b = sorted(map(tuple, E.ANALYSES[name](flat, deposits).collect()), key=repr)
    assert a == b


def test_flat_layout_is_pruned_and_typed(spark, tables):
    _, _, flat = tables
    assert "event_params" not in flat.columns
    assert dict(flat.dtypes)["session_id"] == "bigint"
    assert dict(flat.dtypes)["event_date"] == "string"
    plan = E.ANALYSES["lobby_event_inventory"](flat, None)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_name:string,platform:string,device_category:string,page_location:string>" in plan


@pytest.mark.parametrize("name", sorted(E.NESTED_ONLY))
def test_array_counts_need_nested(spark, tables, name):
    _, deposits, flat = tables
    with pytest.raises(ValueError):
        E.ANALYSES[name](flat, deposits)


def test_a_new_day_leaves_older_days(spark):
    from helpers import ev, events_df
    path = tempfile.mkdtemp(prefix="eventlens-days-", dir=os.environ.get("EVENTLENS_SCRATCH", "/tmp")) + "/flat"
    for day, user in (("20251101", "a"), ("20251102", "b"), ("20251102", "c")):
        write_flat_events(events_df(spark, [ev(user, date=day)]), path)
    got = {(r.event_date, r.user_id) for r in read_flat_events(spark, path).select("event_date", "user_id").collect()}
    assert got == {("20251101", "a"), ("20251102", "c")}   # the third write replaced its own day only
