"""Payments by user cohort (Q22, Q23).

Payments are filtered and pre-aggregated per (player, day) before they meet
the per-user cohort table: the join input is bounded by player-days, so one
very active player cannot overload a join task.  The join keeps players
found in the cohort (the source's left join plus ``user_type IS NOT NULL``),
and the paying players' keys reach the scan of the events as a bit set
(``operators.sideways``), so the cohort is aggregated over their events only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from eventlens.operators.cohort import user_cohort
from eventlens.operators.sideways import only_keys
from eventlens.plans.common import scan
from eventlens.sources.deposits import DAY, with_payment_day

OK_STATUSES = ("CAPTURED", "COMPLETED")
# Amounts are summed and averaged as exact decimals (money), so that
# HALF_UP rounding of a mean that falls on a tie does not depend on the
# order of floating-point additions; results are DOUBLE after rounding.
MONEY = "decimal(30,8)"


def _money(c):
    return F.col(c).cast(MONEY)


def _cohort(events: DataFrame, cohort_from: str, cohort_to: str, cutoff: str,
            payers: DataFrame | None = None) -> DataFrame:
    """(user_id, user_type); with ``payers`` (player_id) only their events, and
    a few others', are aggregated: the cohort labels a few players, the events
    are those of every user."""
    ev = scan(events, cohort_from, cohort_to, [], ["user_id", "event_timestamp"])
    if payers is not None:
        ev = only_keys(ev, "user_id", payers, "player_id")
    return user_cohort(ev.filter(F.col("user_id").isNotNull()), cutoff)


def _payments(deposits: DataFrame, day_from: str, day_to: str, business_unit: str,
              statuses: Sequence[str], positive_only: bool, skip_bad_dates: bool = False) -> DataFrame:
    """Payments of the unit and statuses in the days, with ``deposit_date``.  A
    table kept by day (``sources.deposits``) is pruned to those days and no date
    is parsed; else every date is parsed once."""
    lo, hi = F.lit(day_from).cast("date"), F.lit(day_to).cast("date")
    cond = ((F.col("business_unit_name") == business_unit) & F.col("payment_status").isin(*statuses)
            & F.col("player_id").isNotNull())
    if positive_only:
        cond = cond & (F.col("transaction_amount_EUR") > 0)
    if DAY in deposits.columns or skip_bad_dates:
        deposits = deposits.filter(cond)   # else a bad date of any payment fails the job
    p = with_payment_day(deposits, "deposit_date", skip_bad_dates)
    return p.filter(F.col("deposit_date").between(lo, hi) & cond).select(
        "player_id", "deposit_date", "transaction_amount_EUR")


def _labelled(per_player: DataFrame, cohort: DataFrame) -> DataFrame:
    """Rows per player with the player's ``user_type``; players outside the cohort go."""
    return per_player.withColumnRenamed("player_id", "user_id").join(cohort, "user_id", "inner")


def deposits_by_cohort_per_user(events: DataFrame, deposits: DataFrame, cohort_from: str,
                                cohort_to: str, cutoff: str, day_from: str, day_to: str,
                                business_unit: str, statuses: Sequence[str] = OK_STATUSES,
                                skip_bad_dates: bool = False) -> DataFrame:
    """Q22: per day and user type: depositing players, mean transactions and
    mean amount per player, revenue (zero and negative amounts kept)."""
    pay = _payments(deposits, day_from, day_to, business_unit, statuses, False, skip_bad_dates)
    per_player = pay.groupBy("player_id", "deposit_date").agg(
        F.count(F.lit(1)).alias("transactions"),
        F.avg(_money("transaction_amount_EUR")).alias("avg_amount"),
        F.sum(_money("transaction_amount_EUR")).alias("total_amount"))
    j = _labelled(per_player, _cohort(events, cohort_from, cohort_to, cutoff, pay))
    out = j.groupBy("deposit_date", "user_type").agg(
        F.count("user_id").alias("users_deposited"),   # one row per player and day
        F.round(F.avg("transactions"), 3).alias("avg_transactions_per_user"),
        F.round(F.avg("avg_amount"), 2).cast("double").alias("avg_amount_per_user"),
        F.round(F.sum("total_amount"), 2).cast("double").alias("total_revenue"))
    return out.orderBy("deposit_date", "user_type")


def deposit_amount_stats_by_cohort(events: DataFrame, deposits: DataFrame, cohort_from: str,
                                   cohort_to: str, cutoff: str, day_from: str, day_to: str,
                                   business_unit: str, statuses: Sequence[str] = OK_STATUSES,
                                   skip_bad_dates: bool = False) -> DataFrame:
    """Q23: per day and user type: depositors, transactions, mean, total, min,
    max and sample standard deviation of positive amounts.

    Sums and sums of squares per (player, day) are exact decimals (amounts to
    four decimals) and add up exactly after the join.  The squares are centred
    on the rounded mean m before they become doubles,
    ``sum (x - m)^2 = q - 2 m s + n m^2``, so nothing cancels."""
    pay = _payments(deposits, day_from, day_to, business_unit, statuses, True, skip_bad_dates)
    return _amount_stats(pay, _cohort(events, cohort_from, cohort_to, cutoff, pay))


def _amount_stats(pay: DataFrame, cohort: DataFrame) -> DataFrame:
    x = F.col("transaction_amount_EUR")
    cents = x.cast("decimal(16,4)")
    per_player = pay.groupBy("player_id", "deposit_date").agg(
        F.count(F.lit(1)).alias("n"), F.sum(x.cast(MONEY)).alias("s_exact"),
        F.min(x).alias("lo"), F.max(x).alias("hi"),
        F.sum(cents).alias("s"), F.sum(cents * cents).alias("q"))
    j = _labelled(per_player, cohort)
    n = F.col("n")
    g = j.groupBy("deposit_date", "user_type").agg(
        F.count("user_id").alias("unique_depositors"),   # one row per player and day
        F.sum(n).cast("long").alias("total_deposit_transactions"),
        F.sum("s_exact").alias("_s_exact"), F.min("lo").alias("_lo"), F.max("hi").alias("_hi"),
        F.sum("s").alias("_s"), F.sum("q").alias("_q"))
    N, S = F.col("total_deposit_transactions"), F.col("_s")
    m = F.round(S / N, 4).cast("decimal(16,4)")
    about_m = F.col("_q") - 2 * m * S + N * m * m                # sum of (x - m)^2
    off = (S - N * m).cast("double")
    m2 = F.greatest(about_m.cast("double") - off * off / N.cast("double"), F.lit(0.0))
    out = g.select(
        "deposit_date", "user_type", "unique_depositors", "total_deposit_transactions",
        F.round(F.col("_s_exact") / F.col("total_deposit_transactions"), 2).cast("double")
        .alias("avg_deposit_amount_EUR"),
        F.round(F.col("_s_exact"), 2).cast("double").alias("total_deposited_EUR"),
        F.round(F.col("_lo"), 2).alias("min_amount_EUR"),
        F.round(F.col("_hi"), 2).alias("max_amount_EUR"),
        F.round(F.sqrt(F.try_divide(m2, N.cast("double") - F.lit(1.0))), 2).alias("stddev_amount_EUR"))
    return out.orderBy("deposit_date", "user_type")
