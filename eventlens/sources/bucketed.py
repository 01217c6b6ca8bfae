"""Bucketed event store: the flat layout as a table dealt by user.

The table is partitioned by ``event_date`` and every day is cut into the same
number of buckets by hash of ``user_id``, sorted by (user, session).  A bucket
of all days is one scan task, so everything of a user is already in one place:
the session rollup and the per-user cohort aggregate without an exchange, also
for sessions that go over midnight.  Analyses take the table in place of the
events.

What it asks for: a bucket is as large as its users, so a user (or the NULL
user) with a large share of all events makes one long task.  Such data belongs
in the day-partitioned layouts, whose aggregations combine map-side before they
shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eventlens.schema import FLAT_EVENTS
from eventlens.sources.files import make_folder
from eventlens.sources.layout import to_flat


def create_bucketed_events(spark: SparkSession, table: str, path: str, buckets: int) -> None:
    """Register ``table`` at ``path``, with the days that are already there.  A
    catalog that lives with its session needs this once per session."""
    make_folder(spark, path)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in FLAT_EVENTS.fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet PARTITIONED BY (event_date) "
              f"CLUSTERED BY (user_id) SORTED BY (user_id, session_id) INTO {int(buckets)} BUCKETS LOCATION '{path}'")
    spark.sql(f"ALTER TABLE {table} RECOVER PARTITIONS")


def add_bucketed_events(events: DataFrame, table: str, buckets: int) -> None:
    """Write the days that ``events`` holds; they replace those days and no
    others.  Rows are dealt out as the table is, so a task writes one file per
    day."""
    flat = (to_flat(events).select(*FLAT_EVENTS.names).repartition(buckets, "user_id")
            .sortWithinPartitions("event_date", "user_id", "session_id"))
    spark = events.sparkSession
    mode = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        flat.write.insertInto(table, overwrite=True)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", mode)


def read_bucketed_events(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table)
