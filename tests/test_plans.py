"""Physical plan checks: shard pruning reaches the scan, no cartesian or
nested-loop joins, no Python evaluation, parameter arrays pruned to needs."""

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(E.QUERIES))
def test_plan_shape(spark, name):
    p = plan(E.queries()[name](spark, SF))
    assert "CartesianProduct" not in p
    assert "BroadcastNestedLoopJoin" not in p
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p
    assert "ExistingRDD" not in p
    assert "PartitionFilters: [isnotnull(event_date" in p, "shard range must prune partitions"


def test_filter_pushdown_and_pruning(spark):
    p = plan(E.queries()["lobby_event_inventory"](spark, SF))
    assert "EqualTo(platform,WEB)" in p and "In(device.category, [mobile,tablet])" in p
    # only the columns the query reads are in the scan schema (nested pruning of device)
    assert "ReadSchema: struct<event_name:string,platform:string,device:struct<category:string>," in p
    assert "user_pseudo_id" not in p


@pytest.mark.parametrize("name", ["lobby_session_baseline", "fast_game_start_rates", "weekly_lobby_kpi", "daily_lobby_kpi",
                                  "daily_lobby_kpi_pseudo_id", "tracking_outages"])
def test_rollup_reads_only_the_events_it_uses(spark, name):
    p = plan(E.queries()[name](spark, SF))
    assert "PushedFilters: [In(event_name, [" in p


def test_two_distinct_counts_do_not_multiply_rows(spark):
    for name in ("lobby_volume_by_host_platform", "lobby_volume_by_device", "lobby_sessions_by_url_variant"):
        assert "Expand" not in plan(E.queries()[name](spark, SF))


def test_login_joins_spread_null_and_frequent_users(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("lobby_bounce_rate", "banner_return_vs_gameplay_weekly"):
            p = plan(E.queries()[name](spark, SF))
            assert "hashpartitioning(_join_key" in p and "approx_top_k(" in p, name
        # a user's sessions become a few counts before the join, so no user is frequent there
        for name in ("lobby_funnel_weekly", "carousel_friction", "daily_trend_moving_avg"):
            p = plan(E.queries()[name](spark, SF))
            joined = p[p.index("SortMergeJoin [user_id"):]
            assert joined.count("HashAggregate(keys=[user_id") >= 2 and "explode" not in p, name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_building_the_weekly_return_starts_no_job(spark):
    run = E.queries()["banner_return_vs_gameplay_weekly"]
    run(spark, SF)  # the adapted tables exist from here on
    spark.sparkContext.setJobGroup("build", "build")
    run(spark, SF)
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("build")) == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_weekly_return_reads_two_scans_and_nine_exchanges(spark):
    """The final plan, in which the sketch reuses the join's exchange."""
    df = E.queries()["banner_return_vs_gameplay_weekly"](spark, SF)
    df.collect()
    final = plan(df).split("== Initial Plan ==")[0]
    assert final.count("FileScan parquet") <= 3
    shuffles = [line for line in final.splitlines() if " Exchange " in line]
    assert len(shuffles) <= 9
