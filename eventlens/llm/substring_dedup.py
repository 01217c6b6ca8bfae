"""Removal of repeated passages: level-wise doubling of repeated word windows.

A window is ``window`` consecutive words (W).  A word goes when it is covered
by a window whose words also start in a document with a smaller id.

Level 1 looks at windows of ``b = ceil(W / 4)`` words.  Every W-window is
represented by the one with the smallest hash inside it, so equal W-windows
choose equal representatives and only about one position in 20 is shuffled.
Level 2 doubles: of the representatives that repeat in different documents, the
2b words to the right (or, near the end of the W-window, b to the left and b to
the right) must repeat too.  Level 3 doubles again, up to W: the W-windows whose
level-2 window repeats are counted themselves, which decides.  A level sees
only what survived the one before; nothing that repeats at length W is lost,
because each representative is a part of its W-window chosen by content alone.

Documents with equal word sequences are one class: all but the smallest id are
removed outright and only that one takes part in the levels.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import exclude, prefilter, skew_join, stage
from .words import Words, slices, window_hashes

_NO_ID = 2**63 - 1
_EMPTY = hashlib.sha256(b"").hexdigest()


def _sliding_argmin(x: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost minimum of ``x[i:i + width]`` for every i, by
    doubling; a strided view would be copied ``width`` times."""
    low, at, size = x, np.arange(len(x), dtype=np.int32), 1
    while size < width:
        shift = min(size, width - size)
        right = low[shift:] < low[:-shift]
        low = np.where(right, low[shift:], low[:-shift])
        at = np.where(right, at[shift:], at[:-shift])
        size += shift
    return at


def _represent(words: Words, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all W-windows of a slice and of the level-1 window that
    represents each (the leftmost smallest hash)."""
    b = -(-w // 4)
    small = window_hashes(words.keys, b)
    n = len(words.keys) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    end = np.repeat(words.first[1:], np.diff(words.first))
    starts = np.flatnonzero(np.arange(n) + w <= end[:n])
    return starts, _sliding_argmin(small, w - b + 1)[starts].astype(np.int64)


def _class_key(sha: bytes) -> int:
    return int.from_bytes(sha[:8], "little", signed=True)


def _list(at: np.ndarray, values: np.ndarray, type_, null: np.ndarray | None = None) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values, type_, mask=null))


def _scan(w: int):
    b = -(-w // 4)

    def run(batches):
        for batch in batches:
            for words in slices(batch.column(1)):
                first, keys = words.first, words.keys
                n_docs = len(first) - 1
                shas = [hashlib.sha256(words.joined_all(i)).digest() for i in range(n_docs)]
                pos = np.unique(_represent(words, w)[1])
                at = np.searchsorted(pos, first)
                doc = np.searchsorted(first, pos, "right") - 1
                small, double = window_hashes(keys, b), window_hashes(keys, 2 * b)
                pad = np.append(double, np.zeros(len(keys) + 1 - len(double), np.uint64))
                no_right = pos + 2 * b > first[doc + 1]
                no_left = pos - b < first[doc]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(words.rows.start, n_docs), batch.column(2).slice(words.rows.start, n_docs),
                    pa.array(np.diff(first), pa.int32()),
                    pa.array([s.hex() for s in shas], pa.string()), pa.array(map(_class_key, shas), pa.int64()),
                    _list(at, pos - first[doc], pa.int32()), _list(at, small[pos].view(np.int64), pa.int64()),
                    _list(at, pad[pos].view(np.int64), pa.int64(), no_right),
                    _list(at, pad[np.maximum(pos - b, 0)].view(np.int64), pa.int64(), no_left)],
                    names=["id", "k", "n_words", "sha", "c", "pos", "one", "right", "left"])
    return run


def _windows(w: int):
    """(id, c, start, ha, hb) for the W-windows whose level-2 window survived;
    input (id, c, text, sides), a side being 2 * position + (1 for the left)."""
    b = -(-w // 4)

    def run(batches):
        for batch in batches:
            ids, cs, sides = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
            for words in slices(batch.column(2)):
                first = words.first
                starts, chosen = _represent(words, w)
                ha, hb = (window_hashes(words.keys, w, seed).view(np.int64) for seed in (1, 2))
                doc = np.searchsorted(first, starts, "right") - 1
                side = 2 * (chosen - first[doc]) + (chosen - starts > w - 2 * b)
                keep = np.zeros(len(starts), bool)
                for i, (lo, hi) in enumerate(zip(*(np.searchsorted(doc, np.arange(len(first) - 1), s) for s in ("left", "right")))):
                    row = words.rows.start + i
                    if hi > lo and _class_key(hashlib.sha256(words.joined_all(i)).digest()) == cs[row]:
                        keep[lo:hi] = np.isin(side[lo:hi], sides[row].values.to_numpy())
                starts, doc = starts[keep], doc[keep]
                row = words.rows.start + doc
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (ids[row], cs[row], (starts - first[doc]).astype(np.int32), ha[starts], hb[starts])],
                    names=["id", "c", "start", "ha", "hb"])
    return run


def _cut(w: int):
    """(id, c, n_removed, kept_sha256, kept_text) for documents with windows to remove; input
    (id, c, text, starts)."""
    def run(batches):
        for batch in batches:
            out = []
            ids, cs, starts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)
            for words in slices(batch.column(2)):
                for i in range(len(words.first) - 1):
                    row = words.rows.start + i
                    if _class_key(hashlib.sha256(words.joined_all(i)).digest()) != cs[row]:
                        continue  # another text under the same id
                    n = int(words.first[i + 1] - words.first[i])
                    step = np.zeros(n + 1, np.int64)
                    at = starts[row].values.to_numpy()
                    np.add.at(step, at, 1)
                    np.add.at(step, at + w, -1)
                    keep = np.cumsum(step)[:n] == 0
                    kept = words.joined(i, keep)
                    out.append((ids[row], cs[row], n - int(keep.sum()), hashlib.sha256(kept).hexdigest(),
                                kept.decode()))
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))],
                names=["id", "c", "n_removed", "kept_sha256", "kept_text"])
    return run


def _repeating(rows: DataFrame, key: list[str], name: str) -> DataFrame:
    """Keys of windows that start in documents with different ids."""
    return stage(rows.groupBy(*key).agg(F.min("id").alias("low"), F.max("id").alias("high"),
                                        F.count("*").alias("rows")).filter("low < high").drop("high"), name)


def _surviving(marks: DataFrame) -> DataFrame:
    """Levels 1 and 2: (id, c, k, sides) of the documents that still have
    candidates, k being the content key of one of their texts."""
    one = marks.select("id", "c", "k", F.explode(F.arrays_zip("pos", "one", "right", "left")).alias("m")).select("id", "c", "k", "m.*")
    one = skew_join(one, _repeating(one, ["one"], "level1").drop("low"), ["one"], "rows")
    two = stage(one.select("id", "c", "k", F.explode(F.array(
        F.struct((2 * F.col("pos")).alias("side"), F.col("right").alias("two")),
        F.struct((2 * F.col("pos") + 1).alias("side"), F.col("left").alias("two")))).alias("m"))
        .select("id", "c", "k", "m.*").filter("two is not null"), "doubled")
    two = skew_join(two, _repeating(two, ["two"], "level2").drop("low"), ["two"], "rows")
    return two.groupBy("id", "c").agg(F.min("k").alias("k"), F.collect_set("side").alias("sides"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """One row per row of ``docs``: id, ``n_words``, ``n_removed``,
    ``kept_sha256`` of the kept words joined by one space, and ``kept_text``,
    which is null when nothing was removed (the text stays as it is).

    Words are runs outside 0x20 and 0x09-0x0D, unchanged.  Windows are judged
    on the input.  Null and empty texts have no words; texts shorter than a
    window lose nothing.  Rows that repeat an id never remove each other's
    words; a null id counts as the largest and is returned as null.  Texts are
    found again by (id, hash of the text), so many rows without an id, or with
    the same one, cost no more than others.  An empty table gives an empty
    result."""
    if window < 2:
        raise ValueError("a window has at least two words")
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID))
    source = docs.select(key.alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("k"))
    rows = stage(source.mapInArrow(
        _scan(window), "id long, k long, n_words int, sha string, c long, pos array<int>, one array<long>, "
                       "right array<long>, left array<long>"), "scan")
    narrow = rows.select("id", "n_words", "sha", "c")
    classes = stage(narrow.groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("copies")), "classes")
    member = stage(skew_join(narrow, classes, ["sha"], "copies").drop("copies"), "member")
    copies = member.filter("id > first").select("id", "c").distinct()

    cand = stage(_surviving(exclude(rows.filter(F.col("n_words") >= window), copies, ["id", "c"])), "candidates")
    found = stage(prefilter(source, cand, "k").join(cand, ["id", "k"]).select("id", "c", "text", "sides").mapInArrow(
        _windows(window), "id long, c long, start int, ha long, hb long"), "windows")
    gone = skew_join(found, _repeating(found, ["ha", "hb"], "level3"), ["ha", "hb"], "rows").filter("id > low")
    spans = stage(gone.groupBy("id", "c").agg(F.collect_set("start").alias("starts")), "spans")
    spans = spans.join(cand.select("id", "c", "k"), ["id", "c"])
    cut = prefilter(source, spans, "k").join(spans, ["id", "k"]).select("id", "c", "text", "starts").mapInArrow(
        _cut(window), "id long, c long, n_removed long, kept_sha256 string, kept_text string").dropDuplicates(["id", "c"])

    copy = (F.col("id") > F.col("first")) & (F.col("n_words") >= window)
    return member.join(cut, ["id", "c"], "left").select(
        F.nullif("id", F.lit(_NO_ID)).alias(id_col), F.col("n_words").cast("long").alias("n_words"),
        F.when(copy, F.col("n_words").cast("long")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(_EMPTY)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(copy, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE = """
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), v AS (
  SELECT doc_id, s, md5(array_to_string(ws[s:s + 49], ' ')) AS h
  FROM w, unnest(range(1, greatest(len(ws) - 48, 1))) AS u(s)
), m AS (
  SELECT h, min(doc_id) AS low FROM v GROUP BY h
), gone AS (
  SELECT DISTINCT doc_id, s + k AS p FROM v JOIN m USING (h), unnest(range(0, 50)) AS u(k) WHERE m.low < v.doc_id
), word AS (
  SELECT doc_id, p, ws[p] AS word FROM w, unnest(range(1, len(ws) + 1)) AS u(p)
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n
  FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
