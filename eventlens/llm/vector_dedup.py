"""Near-duplicate vectors by product quantisation over inverted lists.

Vectors of unit length with cosine >= t are at most ``delta = sqrt(2 - 2t)``
apart, which makes every step exact:

* *Coarse lists.*  A vector belongs to the list of its nearest centroid.  For a
  query with nearest centroid c1, the points of another list c lie beyond the
  plane between c and c1; the list is probed unless that plane is farther than
  delta.  These probes are sufficient: no link can be in another list.
* *Codes.*  A list entry holds its residual to the centroid, quantised in
  subspaces, and the exact length e of the quantisation error.  A query makes a
  distance table per subspace; an entry is a candidate when its summed table
  distance is at most delta + e.
* *Rerank.*  The cosine of every candidate is computed in double precision.

Centroids and codebooks are fitted on a bounded sample (``TRAIN``), every vector
is indexed and every vector is a query.  Identical vectors with one label form
a class that is indexed once and counted with its size.  Long lists are cut into
blocks; each pair of an entry block and a query block is a group of bounded
size, which returns counts and a spanning forest of its links instead of pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, skew_join, stage

#: Sample rows and values (rows * dimension) for fitting, most lists, words per
#: codebook, subspaces, and vectors per block.
TRAIN, TRAIN_VALUES, LISTS, WORDS, PARTS, BLOCK = 4096, 1 << 21, 1024, 64, 8, 2048
_NO_ID = 2**63 - 1
_SLACK = 1e-6


def kmeans(x: np.ndarray, k: int, steps: int = 8) -> np.ndarray:
    """Lloyd's algorithm from evenly spaced rows; empty clusters keep their
    centre."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(steps):
        near = np.argmin((centres ** 2).sum(1) - 2 * x @ centres.T, axis=1)
        size = np.bincount(near, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        centres[size > 0] = total[size > 0] / size[size > 0, None]
    return centres


class Index:
    """Centroids and codebooks for unit vectors padded to ``width``."""

    def __init__(self, sample: np.ndarray, width: int, lists: int, threshold: float):
        self.width = -(-width // PARTS) * PARTS
        self.delta = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + _SLACK
        self.threshold = threshold
        x = self.unit(sample)
        self.centres = kmeans(x, min(lists, len(x)))
        left = x - self.centres[self.nearest(x)[0]]
        sub = self.width // PARTS
        self.books = np.stack([kmeans(left[:, p * sub:(p + 1) * sub], min(WORDS, len(x))) for p in range(PARTS)])

    def unit(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), self.width))
        out[:, :rows.shape[1]] = rows / np.linalg.norm(rows, axis=1, keepdims=True)
        return out

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest list of each row and squared distances to all centroids."""
        square = (x ** 2).sum(1)[:, None] + (self.centres ** 2).sum(1) - 2 * x @ self.centres.T
        return square.argmin(1), square

    def probes(self, x: np.ndarray) -> np.ndarray:
        """Boolean (rows, lists): the sufficient probes."""
        home, square = self.nearest(x)
        apart = np.sqrt(np.maximum(((self.centres[home][:, None] - self.centres) ** 2).sum(2), 1e-18))
        beyond = (square - np.take_along_axis(square, home[:, None], 1)) / (2 * apart)
        out = beyond <= self.delta
        out[np.arange(len(x)), home] = True
        return out

    def encode(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (rows, PARTS) and the exact lengths of their errors."""
        left = (x - self.centres[home]).reshape(len(x), PARTS, -1)
        codes = np.stack([np.argmin((b ** 2).sum(1) - 2 * left[:, p] @ b.T, axis=1) for p, b in enumerate(self.books)], 1)
        error = left - self.books[np.arange(PARTS), codes]
        return codes, np.sqrt((error ** 2).sum((1, 2)))

    def candidates(self, x: np.ndarray, cell: int, codes: np.ndarray, error: np.ndarray) -> np.ndarray:
        """Boolean (queries, entries) by distance tables."""
        left = (x - self.centres[cell]).reshape(len(x), PARTS, -1)
        total = np.zeros((len(x), len(codes)))
        for p, book in enumerate(self.books):
            table = (left[:, p] ** 2).sum(1)[:, None] + (book ** 2).sum(1) - 2 * left[:, p] @ book.T
            total += table[:, codes[:, p]]
        return np.sqrt(np.maximum(total, 0)) <= self.delta + error


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length of a list column, as doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _by_width(batch: pa.RecordBatch, column: int):
    """Row numbers and matrix for every vector length in a batch."""
    size = np.diff(batch.column(column).offsets.to_numpy())
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        yield at, _matrix(batch.column(column).take(pa.array(at)))


def _assign(index: Index):
    """(cid, cells): the list of a vector first, then its other probes."""
    def run(batches):
        for batch in batches:
            for at, rows in _by_width(batch, 1):
                for lo in range(0, len(at), 512):
                    x = index.unit(rows[lo:lo + 512])
                    home = index.nearest(x)[0]
                    probes = index.probes(x)
                    probes[np.arange(len(x)), home] = False
                    cells = [[int(h), *np.flatnonzero(p).tolist()] for h, p in zip(home, probes)]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(at[lo:lo + 512])), pa.array(cells, pa.list_(pa.int32()))], names=["cid", "cells"])
    return run


def _forest(q: np.ndarray, e: np.ndarray, q_ids: np.ndarray, e_ids: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what the pairs (q[i], e[i]) connect: every linked
    node with the smallest id of its component."""
    lq, le = q_ids.copy(), e_ids.copy()
    while True:
        before = lq.sum(dtype=np.uint64), le.sum(dtype=np.uint64), lq.copy()
        np.minimum.at(lq, q, le[e])
        np.minimum.at(le, e, lq[q])
        if (lq == before[2]).all() and le.sum(dtype=np.uint64) == before[1]:
            break
    return [(int(n), int(c)) for ids, lab in ((q_ids, lq), (e_ids, le)) for n, c in zip(ids, lab) if n != c]


def _search(index: Index):
    """One block pair: (cid, linked, other); a row with ``other`` is an edge of
    the forest, one without holds how many vectors a query links with."""
    def run(table: pa.Table) -> pa.Table:
        entry = table.column("entry").to_numpy()
        ids, weight = table.column("cid").to_numpy(), table.column("w").to_numpy()
        raw = _matrix(table.column("vec"))
        cell = table.column("cell")[0].as_py()
        e, q = np.flatnonzero(entry), np.flatnonzero(~entry)
        linked, pairs = np.zeros(len(q), np.int64), []
        if len(e) and len(q):
            x = index.unit(raw)
            codes, error = index.encode(x[e], np.full(len(e), cell))
            length = np.linalg.norm(raw, axis=1)
            for lo in range(0, len(q), 256):
                rows = q[lo:lo + 256]
                a, b = np.nonzero(index.candidates(x[rows], cell, codes, error) & (ids[rows][:, None] != ids[e]))
                for part in range(0, len(a), 1 << 16):
                    i, j = a[part:part + (1 << 16)], b[part:part + (1 << 16)]
                    u, v = rows[i], e[j]
                    ok = np.einsum("ij,ij->i", raw[u], raw[v]) / (length[u] * length[v]) >= index.threshold
                    pairs.append((lo + i[ok], j[ok]))
            a, b = (np.concatenate(p) for p in zip(*pairs)) if pairs else (np.zeros(0, int), np.zeros(0, int))
            np.add.at(linked, a, weight[e][b])
            edges = _forest(a, b, ids[q], ids[e]) if len(a) else []
        else:
            edges = []
        some = np.flatnonzero(linked)
        return pa.table({
            "cid": pa.array(np.r_[ids[q][some], [n for n, _ in edges]].astype(np.int64)),
            "linked": pa.array(np.r_[linked[some], np.zeros(len(edges))].astype(np.int64)),
            "other": pa.array([None] * len(some) + [c for _, c in edges], pa.int64())})
    return run


def _fit(classes: DataFrame, threshold: float) -> Index | None:
    n, width = classes.agg(F.count("*"), F.max(F.size("vec"))).first()
    if not n:
        return None
    rows = classes.orderBy(F.xxhash64("cid"), "cid").limit(max(64, min(TRAIN, TRAIN_VALUES // width))).select("vec").collect()
    sample = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        sample[i, :len(r.vec)] = r.vec
    return Index(sample, width, int(min(LISTS, max(1, round(n ** (1 / 3))))), threshold)


def link_vectors(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id",
                 vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of ``vectors``: id, ``n_links`` (other vectors with the
    same label and cosine >= threshold), ``component_id`` (smallest id reachable
    by links) and ``kept`` (id = component_id).

    Vectors that are null, empty, all zero, or hold null or non-finite
    components, and rows without a label, link with nothing; vectors of
    different length never link.  Rows that repeat an id are vectors of their
    own; a null id is the largest and is returned as null.  An empty table
    gives an empty result."""
    rows = vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"), F.col(label_col).alias("label"),
                          F.col(vec_col).cast("array<double>").alias("vec"))
    bad = F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    usable = F.col("label").isNotNull() & F.col("vec").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists("vec", lambda v: v != 0)
    rows = rows.withColumn("cid", F.when(F.coalesce(usable, F.lit(False)), F.xxhash64("label", "vec")))
    classes = stage(rows.filter("cid is not null").groupBy("cid").agg(
        F.first("label").alias("label"), F.first("vec").alias("vec"), F.min("id").alias("first"), F.count("*").alias("w")), "classes")
    index = _fit(classes, threshold)
    ids = rows.select("id", "cid")
    alone = ids.filter("cid is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = alone if index is None else alone.unionByName(_linked(ids.filter("cid is not null"), classes, index))
    null = F.lit(_NO_ID)
    return out.select(F.nullif("id", null).alias(id_col), "n_links", F.nullif("component_id", null).alias("component_id"),
                      (F.col("id") == F.col("component_id")).alias("kept"))


def _linked(ids: DataFrame, classes: DataFrame, index: Index) -> DataFrame:
    cells = stage(classes.select("cid", "vec").mapInArrow(_assign(index), "cid long, cells array<int>"), "cells")
    posted = stage(classes.select("cid", "label", F.size("vec").alias("d")).join(cells, "cid").select(
        "cid", "label", "d", F.posexplode("cells").alias("i", "cell")), "posted")
    key = ["label", "d", "cell"]
    lists = stage(posted.groupBy(*key).agg(
        F.count("*").alias("queries"), F.sum((F.col("i") == 0).cast("long")).alias("entries")).filter("entries > 0"), "lists")
    posted = skew_join(posted, lists, key, "queries")
    q_blocks = F.ceil(F.col("queries") / BLOCK).cast("int")
    e_blocks = F.ceil(F.col("entries") / BLOCK).cast("int")

    def spread(n):
        return F.explode(F.sequence(F.lit(0), n - 1))

    def pick(n):
        return F.pmod(F.xxhash64("cid"), n).cast("int")

    queries = posted.select("cid", *key, F.lit(False).alias("entry"), pick(q_blocks).alias("qb"), spread(e_blocks).alias("eb"))
    entries = posted.filter("i = 0").select("cid", *key, F.lit(True).alias("entry"), spread(q_blocks).alias("qb"), pick(e_blocks).alias("eb"))
    blocks = queries.unionByName(entries).join(classes.select("cid", "vec", "w"), "cid")
    found = stage(blocks.groupBy(*key, "qb", "eb").applyInArrow(_search(index), "cid long, linked long, other long"), "found")
    counts = found.filter("other is null").groupBy("cid").agg(F.sum("linked").alias("linked"))
    info = classes.select("cid", "first", "w").join(counts, "cid", "left")
    comp = components(found.filter("other is not null").select(F.col("cid").alias("a"), F.col("other").alias("b")))
    info = info.join(comp.withColumnRenamed("node", "cid"), "cid", "left")
    info = stage(info, "classes_linked")
    low = stage(info.filter("component is not null").groupBy("component").agg(
        F.min("first").alias("low"), F.count("*").alias("size")), "components")
    linked = skew_join(info.filter("component is not null"), low, ["component"], "size").drop("size")
    info = stage(linked.unionByName(info.filter("component is null").withColumn("low", F.lit(None).cast("long"))).select(
        "cid", "w", (F.coalesce("linked", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("low", "first").alias("component_id")), "info")
    return skew_join(ids, info, ["cid"], "w").select("id", "n_links", "component_id")


def op8_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), linked AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT r.a, l.b FROM reach r JOIN linked l ON r.b = l.a
), low AS (
  SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
), n AS (
  SELECT a AS vec_id, count(*) AS n_links FROM linked GROUP BY a
)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM low LEFT JOIN n USING (vec_id)
"""
