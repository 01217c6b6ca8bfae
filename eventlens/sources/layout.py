"""Flat layout of the event export for repeated analysis at scale.

Every analysis reads a few parameters out of the repeated ``event_params``
array, so scanning the nested export decodes the array (key and value slots)
for every event each time.  ``write_flat_events`` runs once per new shard: it
projects the known parameters to typed columns, keeps the shard partitioning
(``event_date``), and sorts rows within each file by (user, session) so
Parquet min/max statistics cluster by user.  All analyses accept the flat
table in place of the nested one (``flatten`` passes flat columns through),
except the parameter-key inventory (Q02) and the page breakdown (Q21), which
count every entry of the array and refuse a flat table: it keeps only the first
entry of a repeated parameter key.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from eventlens.functions.params import flatten
from eventlens.schema import FLAT_EVENTS, INT_PARAMS, STRING_PARAMS

TOP_LEVEL = ("event_timestamp", "event_name", "user_id", "user_pseudo_id", "platform",
             "device_category", "operating_system", "event_date")


def to_flat(events: DataFrame, keys: Iterable[str] = INT_PARAMS + STRING_PARAMS) -> DataFrame:
    return flatten(events, list(keys), TOP_LEVEL)


def write_flat_events(events: DataFrame, path: str, keys: Iterable[str] = INT_PARAMS + STRING_PARAMS,
                      mode: str = "overwrite") -> None:
    """``overwrite`` replaces the days that ``events`` holds and leaves other
    days alone.  Rows are dealt out by day and rebalanced: AQE splits a large
    day into several files of the advisory size."""
    flat = to_flat(events, keys)
    (flat.hint("rebalance", "event_date").sortWithinPartitions("event_date", "user_id", "session_id")
     .write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("event_date").parquet(path))


def read_flat_events(spark: SparkSession, path: str) -> DataFrame:
    """Explicit schema: nothing is inferred, and ``event_date`` stays text
    (partition discovery would otherwise type the yyyyMMdd values as int)."""
    return spark.read.schema(FLAT_EVENTS).option("basePath", path).parquet(path)
