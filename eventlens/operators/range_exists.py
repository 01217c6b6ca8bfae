"""Range existence per user: did a target event follow within [lo, hi] µs?

``EXISTS (SELECT 1 FROM targets t WHERE t.user = p.user AND lo <= t.ts - p.ts <= hi)``
as a nested-loop or per-user self join emits every (probe, target) pair of a
user; a window over the user puts a hot user into one task.

Here the timeline of every user is cut into buckets of ``bucket_us`` (wider than
``hi - lo``).  The first target at or after ``p.ts + lo`` lies either in the
probe's bucket or is the earliest target of the next bucket, so each bucket's
earliest target is copied into the previous bucket (a small aggregate), and a
running minimum from the latest to the earliest time of each (user, bucket)
finds the next target for each probe.  The frame only grows, so the work is
linear after the sort; no pairs are emitted, and a hot user is spread over as
many tasks as it has busy buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from eventlens.operators.joins import KEY, key_text


def exists_within(probes: DataFrame, targets: DataFrame, user_col: str, probe_ts: str,
                  target_ts: str, lo_us: int, hi_us: int, flag: str,
                  bucket_us: int = 600_000_000) -> DataFrame:
    """Adds ``flag`` (1/0) to ``probes``.  NULL users never match."""
    if not (0 <= lo_us <= hi_us and hi_us - lo_us < bucket_us):
        raise ValueError("need 0 <= lo <= hi and hi - lo < bucket width")
    W = F.lit(bucket_us)
    pcols = probes.columns
    # Probes of a NULL user find no target (targets of NULL users are dropped);
    # they stay in the same pass, each under a key of its own.
    keyed = probes.withColumn(KEY, key_text(probes, [user_col]))

    t = (targets.filter(F.col(user_col).isNotNull() & F.col(target_ts).isNotNull())
         .select(F.col(user_col), F.col(target_ts).alias("_t")))
    t = t.withColumn("_b", F.floor(F.col("_t") / W))
    carry = t.groupBy(user_col, "_b").agg(F.min("_t").alias("_t")).withColumn("_b", F.col("_b") - 1)
    tgt = (t.unionByName(carry).withColumn("_k", F.col("_t")).withColumn("_probe", F.lit(False))
           .withColumn(KEY, F.concat(F.lit("v"), F.col(user_col).cast("string"))))

    p = (keyed.withColumn("_k", F.col(probe_ts) + F.lit(lo_us))
         .withColumn("_b", F.floor(F.col("_k") / W))
         .withColumn("_t", F.lit(None).cast("long"))
         .withColumn("_probe", F.lit(True)))
    both = p.unionByName(tgt, allowMissingColumns=True)
    w = (Window.partitionBy(KEY, "_b").orderBy(F.desc("_k"))
         .rangeBetween(Window.unboundedPreceding, Window.currentRow))
    nxt = F.min("_t").over(w)
    hit = F.when(nxt.isNotNull() & (nxt <= F.col(probe_ts) + F.lit(hi_us)), F.lit(1)).otherwise(F.lit(0))
    return both.withColumn(flag, hit).filter(F.col("_probe")).select(*pcols, flag)


def followed_within(rows: DataFrame, user_col: str, ts_col: str, target: Column, lo_us: int, hi_us: int,
                    flag: str, bucket_us: int = 3_600_000_000) -> DataFrame:
    """Adds ``flag`` (1/0) to ``rows``: does a row of the same user for which
    ``target`` holds follow within [lo, hi] µs?  Probes and targets are rows of
    one table, so it is read and shuffled once: each target in the first ``hi``
    of its (user, bucket) is also dealt, row by row, to the bucket before, and a
    running minimum from late to early that ends ``lo`` before the row gives the
    next target.  NULL users never match."""
    if not 0 <= lo_us <= hi_us < bucket_us:
        raise ValueError("need 0 <= lo <= hi < bucket width")
    columns, width = rows.columns, F.lit(bucket_us)
    bucket = F.floor(F.col(ts_col) / width)
    own, before = (F.struct(b.alias("b"), F.lit(mine).alias("own")) for b, mine in ((bucket, True), (bucket - 1, False)))
    early = F.col("_target") & F.col(user_col).isNotNull() & (F.pmod(F.col(ts_col), width) <= F.lit(hi_us))
    dealt = rows.withColumn(KEY, key_text(rows, [user_col])).withColumn("_target", F.coalesce(target, F.lit(False)))
    dealt = dealt.withColumn("_at", F.explode(F.when(early, F.array(own, before)).otherwise(F.array(own))))
    dealt = dealt.select("*", F.col("_at.b").alias("_b"), F.col("_at.own").alias("_own"))
    later = Window.partitionBy(KEY, "_b").orderBy(F.desc(ts_col)).rangeBetween(Window.unboundedPreceding, -lo_us)
    after = F.min(F.when(F.col("_target") & F.col(user_col).isNotNull(), F.col(ts_col))).over(later)
    hit = F.when(after <= F.col(ts_col) + F.lit(hi_us), F.lit(1)).otherwise(F.lit(0))
    return dealt.withColumn(flag, hit).filter("_own").select(*columns, flag)
