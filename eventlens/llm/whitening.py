"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

Vectors become integers x = floor(256 c); the distinct ones are the rows of the
matrix X, centred by their exact means.  Starting from one direction v, products
``X v`` and ``X' u`` alternate and give orthonormal v_1, v_2, ... and u_1, u_2,
... with ``X V = U B``, B upper bidiagonal.  The SVD of the small B gives
singular values (deviations) and, through V, the components.

Every u lies in the range of X, so it is kept as the direction w with u = X w: a
step is *one* job over the rows.  With the directions of all earlier u in hand, a
task computes for its rows u = X w for all of them, and adds up what the step
needs: ``X' u`` and the products of the new u with all u, by which it is fully
reorthogonalised.  The v are reorthogonalised on the driver.  What reaches the
driver is one sum per dimension and per step; the rows stay where they are.

A start is ``X' X r`` for a random r, so it lies in the row space.  When a start
is used up (an invariant subspace, e.g. equal eigenvalues), the next one is
orthogonal to all v so far, until the row space is exhausted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage

#: x = floor(STEP * c).
STEP = 256
#: Up to this many steps the row space is exhausted; beyond, the iteration ends
#: once the wanted components have converged.
STEPS = 256
#: A norm below this share of the largest one counts as zero, and a residual
#: below it as converged.
ZERO, CONVERGED = 1e-11, 1e-15
_LONG = np.int64(2**63 - 1)

_OUT = ("id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def _integers(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows that are kept, their lengths, integers back to back).  A null
    vector, or one with a null or non-finite entry, is not kept; integers beyond
    a long are clipped to its range."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    present = np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False))
    some = vectors.take(pa.array(present))
    size = np.diff(some.offsets.to_numpy())
    flat = some.flatten()
    value = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(present)), size)
    bad = np.zeros(len(present), bool)
    bad[owner[~np.isfinite(value)]] = True
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.floor(value[~bad[owner]] * STEP)
        # the largest double below 2**63 and -2**63 are the ends of the range
        x = np.clip(scaled, -(2.0**63), 2.0**63 - 1024).astype(np.int64)
    return present[~bad], size[~bad], x


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kept vectors as the bytes of their integers."""
    for batch in batches:
        _, size, x = _integers(batch.column(0))
        at = np.append(0, np.cumsum(size) * 8).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(at), pa.py_buffer(x.astype("<i8").tobytes())])],
            names=["x"])


def _matrix(packed: pa.Array, d: int) -> np.ndarray:
    wide = np.int64 if pa.types.is_large_binary(packed.type) else np.int32
    first = int(np.frombuffer(packed.buffers()[1], wide)[packed.offset]) if len(packed) else 0
    if not len(packed) or not d:
        return np.zeros((len(packed), d), np.int64)
    return np.frombuffer(packed.buffers()[2], "<i8", len(packed) * d, first).reshape(-1, d)


def _sums(fit: DataFrame, d: int, width: int, part) -> np.ndarray:
    """Sum over all rows of ``part(matrix)``, a vector of ``width`` doubles per
    batch; one partial sum per partition reaches the shuffle."""
    def run(batches):
        total = np.zeros(width)
        for batch in batches:
            total += part(_matrix(batch.column(0), d))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(total)], names=["pos", "value"])
    rows = fit.select("x").mapInArrow(run, "pos int, value double").groupBy("pos").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(width)
    for r in rows:
        out[r.pos] = r.value
    return out


def _column_sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of rows and exact sums per dimension: the halves of the integers
    are added apart, so nothing overflows."""
    def run(batches):
        n, high, low = 0, np.zeros(d, object), np.zeros(d, object)
        for batch in batches:
            x = _matrix(batch.column(0), d)
            n += len(x)
            high += (x >> 32).sum(axis=0).astype(object)
            low += (x & 0xFFFFFFFF).sum(axis=0).astype(object)
        totals = [n, *(int(h) * 2**32 + int(v) for h, v in zip(high, low))]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d + 1, dtype=np.int32)), pa.array([str(t) for t in totals])],
                                         names=["pos", "value"])
    rows = fit.select("x").mapInArrow(run, "pos int, value string").groupBy("pos").agg(
        F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    found = {r.pos: int(r.value) for r in rows}
    return found.get(0, 0), [found.get(i + 1, 0) for i in range(d)]


class Components:
    """Unit columns ``vectors`` (d x r) by falling ``values`` (eigenvalues of
    the covariance), and the statistics of the fit list."""

    def __init__(self, n: int, sums: list[int], vectors: np.ndarray, values: np.ndarray, trace: float):
        self.n, self.sums, self.vectors, self.values, self.trace = n, sums, vectors, values, trace
        self.mean = np.array([s / n for s in sums])

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.vectors / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, exactly; null beyond a long."""
        top = self.n * (float(np.abs(x.astype(np.float64)).max(initial=0)) + 1) + max(map(abs, self.sums), default=0)
        if top * top * max(1, x.shape[1]) < 2.0**62:
            return ((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(axis=1).tolist()
        exact = [sum((self.n * int(c) - s) ** 2 for c, s in zip(row, self.sums)) for row in x]
        return [v if v <= int(_LONG) else None for v in exact]


def bidiagonalise(product, d: int, count: int, limit: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, right singular vectors as columns) of X, the first
    ``count``, fewer when the rank is lower.  ``product(W, w)`` with u = X w gives
    (products of u with the columns of X W, u'u, X'u)."""
    rng = np.random.default_rng(13)
    V, W, XU = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((d, 0))
    alpha: list[float] = []
    beta: list[float] = []
    largest = 0.0

    def clean(z: np.ndarray) -> np.ndarray:
        for _ in range(2):
            z = z - V @ (V.T @ z)
        return z

    def fresh() -> np.ndarray | None:
        """A unit direction of the row space, orthogonal to all v."""
        r = clean(rng.standard_normal(d))
        _, square, z = product(np.zeros((d, 0)), r / np.linalg.norm(r))
        scale = max(largest, np.sqrt(max(square, 0.0)))
        z = clean(z)
        size = np.linalg.norm(z)
        return z / size if size > ZERO * scale * scale and scale > 0 else None

    v, link = (fresh(), 0.0) if d else (None, 0.0)
    while v is not None:
        w = v - link * W[:, -1] if link else v.copy()
        for _ in range(3):      # once more while reorthogonalisation takes away most of u
            g, square, xu = product(W, w)
            w, xu = w - W @ g, xu - XU @ g
            left = square - g @ g
            if left >= 0.5 * square or square <= 0:
                break
        a = float(np.sqrt(max(left, 0.0)))
        largest = max(largest, a, link)
        if a <= ZERO * largest:
            break
        V, W, XU = np.column_stack([V, v]), np.column_stack([W, w / a]), np.column_stack([XU, xu / a])
        beta.append(link)
        alpha.append(a)
        z = clean(xu / a - a * v)
        link = float(np.linalg.norm(z))
        if len(alpha) == d:
            break
        if len(alpha) >= limit:
            left_vectors, sigma, _ = np.linalg.svd(np.diag(alpha) + np.diag(beta[1:], 1))
            if (link * np.abs(left_vectors[-1, :count]) <= CONVERGED * len(alpha) * sigma[0]).all():
                break
        if link > ZERO * largest:
            v = z / link
        else:
            link = 0.0
            v = fresh()
    if not alpha:
        return np.zeros(0), np.zeros((d, 0))
    _, sigma, right = np.linalg.svd(np.diag(alpha) + np.diag(beta[1:], 1))
    keep = min(count, int((sigma > 10 * ZERO * sigma[0]).sum()))
    vectors = V @ right[:keep].T
    return sigma[:keep], vectors / np.linalg.norm(vectors, axis=0)


def fit_components(vectors: DataFrame, vector_col: str = "embedding", count: int = 4) -> tuple[Components | None, DataFrame]:
    """Components of the distinct vectors, and those vectors (packed, staged).
    The dimension is that of most distinct vectors (of the larger one when
    equal); others have no part.  None when no vector is left."""
    fit = stage(vectors.select(F.col(vector_col)).mapInArrow(_pack, "x binary").distinct(), "distinct")
    sizes = fit.groupBy(F.octet_length("x").alias("size")).agg(F.count("*").alias("n"))
    most = sizes.orderBy(F.desc("n"), F.desc("size")).first()
    if most is None:
        return None, fit
    d = most.size // 8
    fit = fit.filter(F.octet_length("x") == most.size)
    n, sums = _column_sums(fit, d)
    mean = np.array([s / n for s in sums])

    def product(W: np.ndarray, w: np.ndarray):
        basis, k = np.column_stack([W, w]), W.shape[1]

        def part(x):
            centred = x - mean
            u = centred @ basis
            return np.concatenate([u.T @ u[:, -1], centred.T @ u[:, -1]])
        out = _sums(fit, d, k + 1 + d, part)
        return out[:k], float(out[k]), out[k + 1:]

    sigma, columns = bidiagonalise(product, d, count)
    trace = _sums(fit, d, 1, lambda x: np.array([((x - mean) ** 2).sum()]))[0] / n
    return Components(n, sums, columns, sigma**2 / n, trace), fit


def identity_error(model: Components, fit: DataFrame) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity."""
    r, d = len(model.values), len(model.sums)

    def part(x):
        z = model.project(x)
        return np.concatenate([z.sum(axis=0), (z.T @ z).ravel()])
    out = _sums(fit, d, r + r * r, part)
    mean = out[:r] / model.n
    return float(np.abs(out[r:].reshape(r, r) / model.n - np.outer(mean, mean) - np.eye(r)).max(initial=0.0))


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", count: int = 4) -> DataFrame:
    """Per row of ``vectors`` and component (1 to ``count``): id, ``component``,
    ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    Rows whose vector is null or holds a null or non-finite entry are dropped, as
    are vectors of another dimension than most.  Repeated rows are whitened as
    they come but fitted once; null ids stay null.  Components with no variance
    do not exist: when the covariance has a lower rank, rows have fewer
    components, and none when all vectors are equal.  An empty table gives an
    empty result.  A deviation beyond a long is null."""
    model, fit = fit_components(vectors, vector_col, count)
    if model is None or not len(model.values):
        return vectors.sparkSession.createDataFrame([], _OUT).withColumnRenamed("id", id_col)
    error, r, d = identity_error(model, fit), len(model.values), len(model.sums)
    explained = model.values / model.trace

    def run(batches):
        for whole in batches:
            for lo in range(0, len(whole), 4096):
                batch = whole.slice(lo, 4096)
                kept, size, flat = _integers(batch.column(1))
                same = size == d
                x = flat[np.repeat(same, size)].reshape(-1, d)
                m = len(x)
                each = pa.array(np.repeat(kept[same], r))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(each), pa.array(np.tile(np.arange(1, r + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * r, model.n, np.int64)),
                    pa.array(model.deviation(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), r))),
                    pa.array(model.project(x).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * r, error))],
                    names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    return rows.mapInArrow(run, _OUT).withColumnRenamed("id", id_col)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
