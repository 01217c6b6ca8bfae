"""Helpers shared by the text operators: staged tables, skew-safe joins and
connected components.

Intermediate tables are Parquet files below ``spark.checkpoint.dir`` (shared by
driver and executors), so a lost executor costs a re-read and not a re-run.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

#: A left side is filtered by a broadcast id set up to this many ids (8 bytes
#: each); beyond it the plain shuffled join follows without the filter.
BROADCAST_IDS = 1_000_000


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; nothing is created."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}/{name}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, fixes
    the rows of non-deterministic inputs and is safe against lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_file_order(df: DataFrame) -> DataFrame:
    """The rows of ``df``, a scan of files that Spark wrote, in the order in
    which they were written: by number of the file, then by row.  (A scan deals
    files and parts of files to tasks by size.)"""
    meta = df.metadataColumn("_metadata")
    name = meta["file_name"]
    placed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
                       F.regexp_extract(name, r"part-(\d+)", 1).try_cast("long").alias("file"),
                       name.alias("name"), meta["row_index"].alias("at"))
    order = ["file", "name", "at"]
    return placed.repartitionByRange(*order).sortWithinPartitions(*order).select("row.*")


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of the decimal text of an id, modulo ``n``."""
    return F.crc32(col.cast("string").cast("binary")) % F.lit(n)


def prefilter(df: DataFrame, ids: DataFrame, key: str, limit: int = BROADCAST_IDS) -> DataFrame:
    """Keep the rows of ``df`` whose key is in ``ids`` when the id set is small
    enough to broadcast (it is counted first); otherwise return ``df`` as is.
    Callers join with ``ids`` afterwards, so this only saves shuffle bytes."""
    ids = ids.select(key).distinct()
    if ids.count() > limit:
        return df
    return df.join(F.broadcast(ids), key, "left_semi")


def exclude(df: DataFrame, rows: DataFrame, on: list[str], limit: int = BROADCAST_IDS) -> DataFrame:
    """``df`` without the keys in ``rows``, which are broadcast when their
    count is within the limit."""
    small = rows.count() <= limit
    return df.join(F.broadcast(rows) if small else rows, on, "left_anti")


def skew_join(left: DataFrame, groups: DataFrame, on: list[str], size: str, how: str = "inner") -> DataFrame:
    """Join rows with one row per group when a few groups may hold most rows.

    ``groups[size]`` is the number of rows a group has in ``left``.  Groups
    above a thousandth of all rows (and 64) number fewer than a thousand, so
    they are broadcast; the rest is a shuffled join in which no key is hot.
    ``groups`` should be a staged table: it is read three times."""
    total, most = groups.agg(F.sum(size), F.max(size)).first()
    limit = max(64, (total or 0) // 1000)
    if (most or 0) <= limit:
        return left.join(groups, on, how)
    hot = F.broadcast(groups.filter(F.col(size) > limit))
    cold = groups.filter(F.col(size) <= limit)
    rest = left.join(F.broadcast(groups.filter(F.col(size) > limit).select(*on)), on, "left_anti")
    return left.join(hot, on, "inner").unionByName(rest.join(cold, on, how))


def _star(edges: DataFrame, n_edges: int, large: bool) -> DataFrame:
    """One large-star or small-star step over distinct edges (u, v), u > v."""
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("deg"))
    limit = max(64, n_edges // 500)  # fewer than a thousand hubs have more edges than that
    hubs = low.filter(F.col("deg") > limit).drop("deg")
    rest = both.join(F.broadcast(hubs.select("u")), "u", "left_anti")
    paired = both.join(F.broadcast(hubs), "u").unionByName(
        rest.join(low.filter(F.col("deg") <= limit).drop("deg"), "u"))
    if large:
        out = paired.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = paired.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            paired.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") > F.col("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links`` (a, b: bigint, any order, repeats
    allowed): (node, component) for every linked node, component being the
    smallest node.  Alternates large-star and small-star contraction, each step
    a staged table of edges, until the edges form stars.  The work follows the
    number of links; no links reach the driver."""
    edges = stage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                  .filter("u > v").distinct(), "edges")

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    seen = mark(edges)
    while seen[0]:
        edges = stage(_star(edges, seen[0], large=True), "edges")
        edges = stage(_star(edges, edges.count(), large=False), "edges")
        now = mark(edges)
        if now == seen:
            break
        seen = now
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
