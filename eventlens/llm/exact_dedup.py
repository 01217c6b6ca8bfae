"""Exact deduplication by a stateful stream over digests (built-in functions only).

1. *Feed*: one narrow row per document: digest of the normalised text, stable
   identifier, content locator (hash of the file path, row in the file).
2. *State*: a Structured Streaming aggregation keyed by digest, without
   watermark or expiry, in the disk-backed RocksDB store.  A key retains its
   number of rows and the (identifier, locator) of the row that stays.  Later
   arrivals can be streamed into the same checkpoint.
3. *Check on hits*: every row whose digest is already held by another row is
   compared with the retained row's full bytes.  The texts of both are fetched
   by their locators in one pass, without hashing any text again.  Rows of equal
   digest and other bytes (a collision) are regrouped by their bytes.
4. The narrow feed is joined with the state; texts are not read again.

Hot groups: the state is pre-aggregated before its shuffle, joins go through
``skew_join``, and a group's retained text is copied once per ``FAN`` rows that
are compared with it.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .common import BROADCAST_IDS, exclude, scratch_path, skew_join, stage

#: State on disk; memory bounded per executor; no 4 MB of preallocated log per
#: state partition, which would outweigh the state itself.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.maintenanceInterval": "10s",   # a finished stream's stores are closed
}
#: Rows compared with one copy of a retained text.
FAN = 1000
#: Hits whose locators are broadcast to the scan of the texts; more are joined
#: by shuffle.
BROADCAST_HITS = BROADCAST_IDS // 10


def normalised(text: Column) -> Column:
    """Null as empty; only A-Z lower-cased.  ``lower`` changes more, but not in a
    text of ASCII alone, where it is much faster than going by characters."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def locatable(docs: DataFrame) -> DataFrame:
    """Columns ``doc`` (the whole row), ``_file`` and ``_row``; a frame that is
    not a plain file scan is staged first, so that a row can be found again."""
    def located(df):
        meta = df.metadataColumn("_metadata")
        return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("doc"),
                         F.xxhash64(meta["file_path"]).alias("_file"), meta["row_index"].alias("_row"))
    try:
        return located(docs)
    except AnalysisException:
        return located(stage(docs, "docs"))


def stream_state(spark: SparkSession, feed_path: str, schema, checkpoint: str,
                 files_per_batch: int | None = None) -> DataFrame:
    """Run the stateful stream over all files of ``feed_path`` that this
    checkpoint has not seen and return the whole state: one row per digest with
    ``n_rows`` and ``best`` = the largest (identifier, locator)."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        query = (reader.parquet(feed_path).groupBy("digest")
                 .agg(F.count("*").alias("n_rows"), F.max(F.struct("id", "_file", "_row")).alias("best"))
                 .writeStream.outputMode("update").format("noop")
                 .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    state = spark.read.format("statestore").load(checkpoint)
    count, best = state.schema["value"].dataType.fieldNames()
    return state.select(F.col("key.digest").alias("digest"), F.col(f"value.`{count}`").alias("n_rows"),
                        F.col(f"value.`{best}`").alias("best"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                digest=sha256, files_per_batch: int | None = None) -> DataFrame:
    """One row per row of ``docs``: id, ``keep_id``, ``group_size``, ``kept``,
    ``text_sha256``, and the locator ``_file``, ``_row`` (hash of the file path,
    row in the file).

    Of equal texts the row with the largest id stays; null ids are smallest,
    and of rows that repeat an id the one with the largest locator stays, so
    exactly one row of a group has ``kept``.  Null text counts as empty.  An
    empty table gives an empty result.  ``digest`` maps the normalised text to
    the state's key; a weak one costs comparisons, never correctness."""
    spark = docs.sparkSession
    return _decide(locatable(docs).select(F.col("doc")[id_col].alias("id"), F.col("doc")[text_col].alias("text"), "_file", "_row"),
                   digest, files_per_batch).withColumnRenamed("id", id_col)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with their columns."""
    rows = locatable(docs)
    decided = _decide(rows.select(F.col("doc")[id_col].alias("id"), F.col("doc")[text_col].alias("text"), "_file", "_row"))
    gone = stage(decided.filter(~F.col("kept")).select("_file", "_row"), "copies")
    return exclude(rows, gone, ["_file", "_row"]).select("doc.*")


def _decide(rows: DataFrame, digest=sha256, files_per_batch: int | None = None) -> DataFrame:
    spark = rows.sparkSession
    norm = normalised(F.col("text"))
    path = scratch_path(spark, "feed")
    sha = [] if digest is sha256 else [sha256(norm).alias("text_sha256")]
    feed = rows.select("id", "_file", "_row", digest(norm).alias("digest"), *sha)
    feed.write.parquet(path)
    feed = spark.read.schema(feed.schema).parquet(path)
    state = stream_state(spark, path, feed.schema, scratch_path(spark, "state"), files_per_batch)
    groups = stage(state.filter("n_rows > 1"), "groups")
    member = skew_join(feed, groups, ["digest"], "n_rows", "left").select(
        "id", "_file", "_row", "digest", F.col("text_sha256" if sha else "digest").alias("text_sha256"),
        F.coalesce("n_rows", F.lit(1)).alias("n_rows"),
        F.coalesce("best", F.struct("id", "_file", "_row")).alias("best"))
    hits = skew_join(feed.select("id", "_file", "_row", "digest"), groups, ["digest"], "n_rows")
    other = _collisions(rows, stage(hits, "hits"))
    if not other.isEmpty():
        member = _regroup(member, other)
    me = F.struct("id", "_file", "_row")
    return member.select("id", F.col("best.id").alias("keep_id"),
                         F.col("n_rows").cast("long").alias("group_size"),
                         (me == F.col("best")).alias("kept"), "text_sha256", "_file", "_row")


def _collisions(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """Staged rows (id, locator, digest, bytes) whose normalised bytes differ
    from those of the row that their digest's key retains."""
    at = ["_file", "_row"]
    fan = F.floor((F.col("n_rows") - 1) / FAN).cast("int")
    wanted = hits.select(*at, "id", "digest", fan.alias("fan"), (F.struct("id", *at) == F.col("best")).alias("is_best"))
    if wanted.count() <= BROADCAST_HITS:
        wanted = F.broadcast(wanted)
    texts = stage(rows.select(*at, "text").join(wanted, at), "texts")
    held = texts.filter("is_best").select(
        "digest", F.col("text").alias("held"), F.explode(F.sequence(F.lit(0), F.col("fan"))).alias("salt"))
    asked = texts.filter(~F.col("is_best")).select(
        "id", *at, "digest", "text", F.pmod(F.xxhash64("id", *at), F.col("fan") + 1).cast("int").alias("salt"))
    same = (F.col("text").eqNullSafe(F.col("held"))
            | (normalised(F.col("text")).cast("binary") == normalised(F.col("held")).cast("binary")))
    return stage(asked.join(held, ["digest", "salt"]).filter(~same)
                 .select("id", *at, "digest", normalised(F.col("text")).alias("bytes")), "collisions")


def _regroup(member: DataFrame, other: DataFrame) -> DataFrame:
    """Take the colliding rows out of their digest's group, which shrinks, and
    group them by their bytes."""
    fresh = other.groupBy("digest", "bytes").agg(
        F.count("*").alias("n_new"), F.max(F.struct("id", "_file", "_row")).alias("best_new"))
    moved = other.join(fresh, ["digest", "bytes"]).select("_file", "_row", "n_new", "best_new")
    gone = other.groupBy("digest").agg(F.count("*").alias("n_gone"))
    return member.join(gone, "digest", "left").join(moved, ["_file", "_row"], "left").select(
        "id", "_file", "_row", "digest", "text_sha256",
        F.coalesce("n_new", F.col("n_rows") - F.coalesce("n_gone", F.lit(0))).alias("n_rows"),
        F.coalesce("best_new", "best").alias("best"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM n
"""
