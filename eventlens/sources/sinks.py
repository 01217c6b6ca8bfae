"""Result sinks: CSV with header (NULL as empty field) and Parquet.

With ``versioned`` a result is published as a snapshot (``sources.snapshots``):
readers never see an empty or half-written folder."""

from __future__ import annotations

from pyspark.sql import DataFrame

from eventlens.sources.snapshots import publish

CSV = {"header": "true", "nullValue": "", "emptyValue": "\"\""}


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", versioned: bool = False) -> None:
    if versioned:
        publish(df, path, "csv", options=CSV)
    else:
        df.write.mode(mode).options(**CSV).csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite",
                  partition_by: str | None = None, versioned: bool = False) -> None:
    if versioned:
        if partition_by:
            raise ValueError("a snapshot replaces the whole result and is not partitioned")
        publish(df, path)
        return
    w = df.write.mode(mode)
    if partition_by:   # replaces the partitions written, not the others
        w = w.partitionBy(partition_by).option("partitionOverwriteMode", "dynamic")
    w.parquet(path)
