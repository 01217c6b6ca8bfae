"""Reader for the nested event export.

Layout expected at scale: Parquet partitioned by ``event_date=yyyyMMdd``
(one directory per daily shard), files sorted by ``user_id``.  The schema is
given explicitly, so no file is touched for inference, and the shard range
filter becomes a partition filter (whole directories are skipped).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from eventlens.schema import EVENTS


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.schema(EVENTS)
            .option("basePath", path)
            .parquet(path))


def shard_range(events: DataFrame, date_from: str, date_to: str) -> DataFrame:
    """Shard range: ``event_date`` between ``date_from`` and ``date_to`` (inclusive yyyyMMdd text)."""
    return events.filter(F.col("event_date").between(F.lit(date_from), F.lit(date_to)))
