"""Payments kept by day, dates parsed once, and the cohort restricted to the
paying players."""

import random

import pytest

import __spark_entry__ as E
from eventlens import plans
from eventlens.__main__ import main
from eventlens.operators import only_keys
from eventlens.operators.sideways import key_bits
from eventlens.sources import read_deposits_by_day, write_deposits_by_day
from eventlens.sources.fixtures import fixture_deposits, load_fixture

SF = "/root/testdata/sf0.001"
PAYMENT_QUERIES = ["deposits_by_cohort_per_user", "deposit_amount_stats_by_cohort", "deposit_vs_banner_correlation",
                   "deposit_period_comparison"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PAYMENT_QUERIES)
def test_payment_queries_prune_days_and_parse_nothing(spark, name):
    p = plan(E.queries()[name](spark, SF))
    assert "PartitionFilters: [isnotnull(deposit_day" in p
    assert "RLIKE" not in p and "date_created" not in p


@pytest.mark.parametrize("name", PAYMENT_QUERIES)
def test_undated_layout_gives_the_same_rows_and_parses_each_date_once(spark, name):
    events, by_day = load_fixture(spark, SF)
    flat = by_day.drop("deposit_day")
    run = E.ANALYSES[name](events, flat)
    optimized = run._jdf.queryExecution().optimizedPlan().toString()
    per_scan = optimized.count("RLIKE") / max(1, optimized.count("explode(array("))
    assert per_scan == 1
    assert sorted(map(tuple, run.collect()), key=repr) == sorted(map(tuple, E.ANALYSES[name](events, by_day).collect()), key=repr)


def test_only_keys_keeps_all_of_the_keys_and_few_others(spark):
    rnd = random.Random(2)
    keys = [f"p{i}" for i in range(300)]
    rows = [(rnd.choice(keys + [f"u{i}" for i in range(20000)] + [None]), i) for i in range(30000)]
    left = spark.createDataFrame(rows, "user_id string, n long")
    right = spark.createDataFrame([(k,) for k in keys] * 2 + [(None,)], "player_id string")
    kept = {r.n for r in only_keys(left, "user_id", right, "player_id").collect()}
    wanted = {n for u, n in rows if u in set(keys)}
    assert wanted <= kept and len(kept) <= len(wanted) + 10      # 300 bits of 8 million are set
    crowded = {r.n for r in only_keys(left, "user_id", right, "player_id", words=1).collect()}
    assert wanted <= crowded                                     # a full set lets everything pass
    nothing = spark.createDataFrame([], "player_id string")
    assert only_keys(left, "user_id", nothing, "player_id").count() == 0


def test_key_bits_have_a_fixed_size(spark):
    for n in (0, 10, 5000):
        keys = spark.range(n).selectExpr("cast(id as string) as k")
        words = key_bits(keys, "k", 256).collect()
        assert len(words) == 1 and len(words[0][0]) == 256
        assert sum(bin(w & 2**64 - 1).count("1") for w in words[0][0]) <= n


def test_events_reaching_the_cohort_are_the_payers(spark):
    """The rows that the cohort aggregates fall to the events of paying players."""
    from eventlens.operators.cohort import user_cohort
    from eventlens.plans.deposits import OK_STATUSES, _cohort, _payments
    events, deposits = load_fixture(spark, SF)
    pay = _payments(deposits, "2024-01-02", "2024-01-02", "SITE_A", OK_STATUSES, True)
    payers = {r[0] for r in pay.select("player_id").distinct().collect()}
    assert 0 < len(payers) < 100
    full = {r.user_id: r.user_type for r in user_cohort(events.filter("user_id is not null"), "2024-01-09").collect()}
    some = {r.user_id: r.user_type for r in _cohort(events, "20231231", "20240131", "2024-01-09", pay).collect()}
    assert set(some) == payers & set(full) and all(full[u] == t for u, t in some.items())
    assert len(some) < len(full)
    assert "subquery" in plan(_cohort(events, "20231231", "20240131", "2024-01-09", pay)).lower()


def test_correlation_scans_the_cohort_once(spark):
    df = E.queries()["deposit_vs_banner_correlation"](spark, SF)
    df.collect()
    assert "ReusedExchange" in plan(df)


def test_cli_reads_payments_by_day(spark, tmp_path, capsys, monkeypatch):
    events, deposits = load_fixture(spark, SF)
    raw = fixture_deposits(spark.read.parquet(f"{SF}/orders.parquet"))
    write_deposits_by_day(raw, str(tmp_path / "by_day"))
    assert read_deposits_by_day(spark, str(tmp_path / "by_day")).count() == raw.count()
    raw.write.parquet(str(tmp_path / "flat"))
    events.write.partitionBy("event_date").parquet(str(tmp_path / "events"))
    monkeypatch.setattr(type(spark), "stop", lambda self: None)
    params = ["cohort_from=20231231", "cohort_to=20240131", "cutoff=2024-01-09", "day_from=2024-01-01", "day_to=2024-01-20",
              "business_unit=SITE_A"]
    out = []
    for layout in (["--deposits", str(tmp_path / "flat")], ["--deposits", str(tmp_path / "by_day"), "--deposits-by-day"]):
        assert main(["deposit_amount_stats_by_cohort", "--events", str(tmp_path / "events"), *layout, "--show", "500", *params]) == 0
        out.append(capsys.readouterr().out)
    assert out[0] == out[1] and "rows shown" in out[0]


def test_result_equals_reference_formula(spark):
    """Q22 against a plain Python computation."""
    events, deposits = load_fixture(spark, SF)
    got = {(str(r.deposit_date), r.user_type): (r.users_deposited, r.total_revenue) for r in
           plans.deposits_by_cohort_per_user(events, deposits, "20231231", "20240131", "2024-01-09", "2024-01-05", "2024-01-07", "SITE_A").collect()}
    first = {}
    for r in events.select("user_id", "event_timestamp").collect():
        if r.user_id is not None:
            first[r.user_id] = min(first.get(r.user_id, r.event_timestamp), r.event_timestamp)
    want = {}
    for r in deposits.collect():
        day = str(r.deposit_day)
        if ("2024-01-05" <= day <= "2024-01-07" and r.business_unit_name == "SITE_A" and r.payment_status in ("CAPTURED", "COMPLETED")
                and r.player_id in first):
            kind = "RETURNING_USER" if first[r.player_id] < 1_704_758_400_000_000 else "NEW_USER"
            users, total = want.setdefault((day, kind), (set(), []))
            users.add(r.player_id)
            total.append(r.transaction_amount_EUR)
    assert got == {k: (len(u), round(sum(t), 2)) for k, (u, t) in want.items()}
