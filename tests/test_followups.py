"""Follow-up analyses X1-X3."""

import datetime as dt

import pytest

from eventlens.plans.followups import daily_correlation


def test_x1_correlation_on_shared_days(spark):
    d = [dt.date(2025, 11, i) for i in range(1, 6)]
    dep = spark.createDataFrame([(x, "NEW_USER", float(i)) for i, x in enumerate(d)],
                                "deposit_date date, user_type string, avg_deposit_amount_EUR double")
    ban = spark.createDataFrame([(x, "NEW_USER", 2.0 * i + 1) for i, x in enumerate(d[1:], 1)]
                                + [(dt.date(2025, 12, 1), "NEW_USER", 5.0)],
                                "activity_date date, user_type string, banner_click_rate_pct double")
    r = daily_correlation(dep, ban).collect()
    assert len(r) == 1 and r[0].days == 4
    assert r[0].corr_amount_vs_click_rate == pytest.approx(1.0)


def test_x3_runs_cover_every_day(spark):
    import __spark_entry__ as E
    sf = "/root/testdata/sf0.01"
    runs = E.queries()["tracking_outages"](spark, sf).collect()
    daily = E.queries()["daily_lobby_kpi"](spark, sf).collect()
    assert sum(r.run_days for r in runs) == len(daily)
    assert sum(r.sessions for r in runs) == sum(r.sessions for r in daily)
