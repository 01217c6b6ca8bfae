"""Follow-up analyses described in the source comments.

All three start from the outputs of the registered analyses (small per-day
tables), so their windows and joins run over days x groups, not events.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from eventlens.plans.deposits import MONEY, OK_STATUSES, _amount_stats, _cohort, _labelled, _payments
from eventlens.plans.funnel import _daily_trend
from eventlens.plans.kpi import daily_lobby_kpi

OUTAGE_RATES = ("gameplay_anytime_rate", "promo_click_rate", "deposit_window_rate",
                "deposit_initiated_rate", "deposit_success_rate")


def tracking_outages(events: DataFrame, date_from: str, date_to: str,
                     lobby_path: str = "/tr/casino", user_col: str = "user_id") -> DataFrame:
    """X3: runs of consecutive days per (OS, user type) that are tracking
    outages (sessions > 0 but every tracked rate 0 or undefined) or stable.

    Gaps and islands on the daily KPI (Q12): a run breaks when the state
    changes or a calendar day is missing."""
    daily = daily_lobby_kpi(events, date_from, date_to, lobby_path, user_col)
    zero = [F.coalesce(F.col(c), F.lit(0.0)) == 0.0 for c in OUTAGE_RATES]
    outage = (F.col("sessions") > 0)
    for z in zero:
        outage = outage & z
    d = daily.select("activity_date", "operating_system", "user_type", "sessions",
                     outage.alias("is_outage"))
    w = Window.partitionBy("operating_system", "user_type").orderBy("activity_date")
    prev_date = F.lag("activity_date").over(w)
    prev_state = F.lag("is_outage").over(w)
    starts = F.when(prev_date.isNull() | (F.date_diff("activity_date", prev_date) != 1)
                    | (prev_state != F.col("is_outage")), F.lit(1)).otherwise(F.lit(0))
    d = d.withColumn("_start", starts)
    d = d.withColumn("run_id", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    out = d.groupBy("operating_system", "user_type", "run_id", "is_outage").agg(
        F.min("activity_date").alias("run_start"), F.max("activity_date").alias("run_end"),
        F.count(F.lit(1)).alias("run_days"), F.sum("sessions").cast("long").alias("sessions"))
    return out.orderBy("operating_system", "user_type", "run_start")


def deposit_period_comparison(events: DataFrame, deposits: DataFrame, cohort_from: str, cohort_to: str,
                              cutoff: str, periods: Sequence[tuple[str, str, str]], business_unit: str,
                              statuses: Sequence[str] = OK_STATUSES, skip_bad_dates: bool = False) -> DataFrame:
    """X2: deposits per named period (label, first day, last day) and user type:
    depositors, transactions, average and total positive amount.  Periods may
    leave gaps; days outside every period are ignored."""
    lo = min(p[1] for p in periods)
    hi = max(p[2] for p in periods)
    pay = _payments(deposits, lo, hi, business_unit, statuses, True, skip_bad_dates)
    label = None
    for name, a, b in periods:
        cond = F.col("deposit_date").between(F.lit(a).cast("date"), F.lit(b).cast("date"))
        label = F.when(cond, F.lit(name)) if label is None else label.when(cond, F.lit(name))
    pay = pay.withColumn("period", label).filter(F.col("period").isNotNull())
    per_player = pay.groupBy("player_id", "period").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("transaction_amount_EUR").cast(MONEY)).alias("s"))
    j = _labelled(per_player, _cohort(events, cohort_from, cohort_to, cutoff, pay))
    g = j.groupBy("period", "user_type").agg(
        F.count("user_id").alias("depositors"),   # one row per player and period
        F.sum("n").cast("long").alias("transactions"),
        F.sum("s").alias("_s"))
    out = g.select("period", "user_type", "depositors", "transactions",
                   F.round(F.col("_s") / F.col("transactions"), 2).cast("double").alias("avg_deposit_amount_EUR"),
                   F.round(F.col("_s"), 2).cast("double").alias("total_deposited_EUR"))
    return out.orderBy("period", "user_type")


def deposit_vs_banner_correlation(events: DataFrame, deposits: DataFrame, cohort_from: str, cohort_to: str,
                                  date_from: str, date_to: str, cutoff: str, day_from: str, day_to: str,
                                  business_unit: str, section_path: str = "/tr/casino",
                                  statuses: Sequence[str] = OK_STATUSES) -> DataFrame:
    """X1: per user type, Pearson correlation of the daily average deposit
    amount (Q23) with the daily banner click rate (Q18), over the days present
    in both; to 9 decimals.

    Both inputs join the same cohort, so its events are scanned and aggregated
    once (the second join reuses the exchange)."""
    cohort = _cohort(events, cohort_from, cohort_to, cutoff)
    pay = _payments(deposits, day_from, day_to, business_unit, statuses, True)
    return daily_correlation(_amount_stats(pay, cohort), _daily_trend(events, cohort, date_from, date_to, section_path))


def daily_correlation(daily_deposits: DataFrame, daily_banner: DataFrame) -> DataFrame:
    """X1 on ready-made outputs of Q23 and Q18."""
    j = daily_deposits.select(F.col("deposit_date").alias("d"), "user_type", "avg_deposit_amount_EUR") \
        .join(daily_banner.select(F.col("activity_date").alias("d"), "user_type", "banner_click_rate_pct"),
              ["d", "user_type"], "inner")
    x, y = "avg_deposit_amount_EUR", "banner_click_rate_pct"
    corr = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))   # NULL when one is constant
    out = j.groupBy("user_type").agg(
        F.count(F.lit(1)).alias("days"), F.round(corr, 9).alias("corr_amount_vs_click_rate"))
    return out.orderBy("user_type")
