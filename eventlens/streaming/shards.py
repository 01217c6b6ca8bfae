"""Structured Streaming over the partitioned event export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from eventlens.functions.params import flatten
from eventlens.functions.predicates import lobby_root, mobile_or_tablet
from eventlens.schema import EVENTS
from eventlens.session import checkpoint_dir
from eventlens.sources.snapshots import publish


def read_event_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """New Parquet files under ``path`` (``event_date=yyyyMMdd`` directories)
    as a stream with the fixed nested schema; ``event_date`` comes from the
    directory name."""
    reader = spark.readStream.schema(EVENTS).option("basePath", path)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def event_inventory_counts(events: DataFrame, date_from: str, date_to: str,
                           lobby_path: str = "/tr/casino", platform: str = "WEB") -> DataFrame:
    """Q04 without the final sort: usable on a streaming DataFrame."""
    ev = flatten(events.filter(F.col("event_date").between(date_from, date_to)), ["page_location"],
                 ["event_name", "platform", "device_category"])
    ev = ev.filter((F.col("platform") == platform) & mobile_or_tablet("device_category")
                   & lobby_root("page_location", lobby_path))
    return ev.groupBy("event_name").agg(F.count(F.lit(1)).alias("event_count"))


def start_event_inventory(spark: SparkSession, source: str, date_from: str, date_to: str,
                          query_name: str = "lobby_event_inventory",
                          checkpoint: str | None = None, sink: str = "memory") -> StreamingQuery:
    """Keep the lobby event inventory (Q04) current as shards arrive.

    Complete-mode aggregation: state is one row per event name.  With
    ``sink="memory"`` the result is the table ``query_name``; otherwise
    ``sink`` is a path where each trigger publishes a Parquet snapshot
    (``sources.snapshots.read_snapshot``)."""
    counts = event_inventory_counts(read_event_stream(spark, source), date_from, date_to)
    ckpt = checkpoint or f"{checkpoint_dir(spark).rstrip('/')}/stream-{query_name}"
    w = counts.writeStream.outputMode("complete").option("checkpointLocation", ckpt).queryName(query_name)
    if sink == "memory":
        return w.format("memory").start()

    def snapshot(batch: DataFrame, _epoch: int) -> None:
        publish(batch, sink)
    return w.foreachBatch(snapshot).start()
