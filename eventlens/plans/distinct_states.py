"""Exact distinct counts that merge: bitmaps of dense numbers, per day and group.

Distinct users and sessions do not add up over days, so counting them shuffles
every (group, user, session) of the range again.  Here every user and session
gets a dense number once (``add_numbers``, append-only), and a day becomes, per
group and per 32,768 numbers, one bitmap.  A range of days is the union of its
bitmaps: what is shuffled is bounded by groups times buckets, whatever the
number of events.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from eventlens.plans.common import session_key
from eventlens.sources.events import shard_range
from eventlens.sources.files import exists

#: Parts in which new keys are numbered side by side.
PARTS = 4096
#: What is numbered; the one ``group`` keeps groups without any known user.
USER, SESSION, GROUP = "user", "session", "group"
NUMBERS = "kind string, key string, n long"


def keys_of(rows: DataFrame) -> DataFrame:
    """Rows with (kind, key): the user, the session of a known user, the group."""
    each = F.array(*[F.struct(F.lit(kind).alias("kind"), key.alias("key")) for kind, key in (
        (USER, F.col("user_id")), (SESSION, session_key()), (GROUP, F.lit("")))])
    return rows.select("*", F.inline(each)).drop("user_id", "session_id").filter("key is not null").distinct()


def numbered(keys: DataFrame, known: DataFrame) -> DataFrame:
    """(kind, key, n) of the keys that ``known`` lacks, with the next numbers of
    their kind, without gaps from 1.  Keys are ranked within parts by hash, and
    the parts' sizes, at most ``PARTS`` rows a kind, are added up."""
    new = keys.select("kind", "key").distinct().join(known.select("kind", "key"), ["kind", "key"], "left_anti")
    new = new.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(PARTS)).cast("int"))
    sizes = new.groupBy("kind", "part").agg(F.count(F.lit(1)).alias("size"))
    used = known.groupBy("kind").agg(F.max("n").alias("used"))
    before = F.sum("size").over(Window.partitionBy("kind").orderBy("part")) - F.col("size")
    starts = sizes.withColumn("before", before).join(F.broadcast(used), "kind", "left")   # three kinds
    place = F.row_number().over(Window.partitionBy("kind", "part").orderBy("key"))
    ranked = new.withColumn("place", place).join(F.broadcast(starts.drop("size")), ["kind", "part"])
    return ranked.select("kind", "key", (F.coalesce("used", F.lit(0)) + F.col("before") + F.col("place")).alias("n"))


def read_numbers(spark: SparkSession, path: str) -> DataFrame:
    if not exists(spark, path):
        return spark.createDataFrame([], NUMBERS)
    return spark.read.schema(NUMBERS).parquet(path)


def add_numbers(rows: DataFrame, path: str) -> None:
    """Number the users and sessions of ``rows`` that have no number yet; those
    given before never change.  One writer at a time."""
    numbered(keys_of(rows), read_numbers(rows.sparkSession, path)).write.mode("append").parquet(path)


def distinct_states(rows: DataFrame, keys: Sequence[str], numbers: DataFrame) -> DataFrame:
    """(event_date, keys, kind, bucket, bits) of ``rows`` (event_date, keys,
    user_id, session_id); every user and session of them must have a number."""
    one = keys_of(rows.select("event_date", *keys, "user_id", "session_id"))
    with_n = one.join(numbers, ["kind", "key"], "left")
    n = F.coalesce("n", F.raise_error(F.concat(F.lit("no number for "), F.col("kind"), F.lit(" "), F.col("key"))).cast("long"))
    placed = with_n.select("event_date", *keys, "kind", F.bitmap_bucket_number(n).alias("bucket"), F.bitmap_bit_position(n).alias("bit"))
    return placed.groupBy("event_date", *keys, "kind", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def write_distinct_states(states: DataFrame, path: str) -> None:
    """Replaces the days written and leaves others alone."""
    (states.hint("rebalance", "event_date").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("event_date").parquet(path))


def read_distinct_states(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    columns = ", ".join(f"`{k}` string" for k in keys)
    return spark.read.schema(f"{columns}, kind string, bucket long, bits binary, event_date string").option("basePath", path).parquet(path)


def sessions_and_users(states: DataFrame, date_from: str, date_to: str, keys: Sequence[str]) -> DataFrame:
    """Distinct sessions and users per group over the days, from the states
    alone; sorted like the volume analyses (Q01, Q03, Q06)."""
    merged = shard_range(states, date_from, date_to).groupBy(*keys, "kind", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    counted = merged.select(*keys, "kind", F.bitmap_count("bits").alias("n"))

    def of(kind: str):
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0))
    out = counted.groupBy(*keys).agg(of(SESSION).alias("sessions"), of(USER).alias("users"))
    return out.orderBy(F.desc("sessions"), *keys)
