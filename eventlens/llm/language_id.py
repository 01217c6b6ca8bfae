"""Language identification with blended-spectrum string kernels.

A text is the set of its character n-grams (n = 1..3, lower-cased, runs of
non-letters as one space), hashed into ``DIM`` places; the kernel of two texts
is the number of shared n-grams over the root of both sizes.  Nyström landmarks
give a finite feature map, on which one-versus-rest kernel ridge regression is
fitted.  With P the presence rows of a batch, L the landmarks' and A the fitted
m x classes matrix, the scores are ``(P / |P|) @ (L' @ A)``: the second product
is made once, so a batch costs one matrix product.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import crc_mod
from .kernel import nystrom_map, ridge

DIM = 1 << 15
GRAMS = (1, 2, 3)
#: Bounds of the training sample: documents in all, documents per language,
#: landmarks in all.
MAX_TRAIN, PER_LANGUAGE, LANDMARKS = 4000, 400, 256
RIDGE = 1e-2
_BATCH_CHARS, _BATCH_ROWS = 1 << 20, 128


def _letters() -> np.ndarray:
    """Which code points are letters; built once per process."""
    cache = sys.modules.setdefault("_llm_letters", types.ModuleType("_llm_letters")).__dict__
    if "table" not in cache:
        cache["table"] = np.fromiter(map(str.isalpha, map(chr, range(sys.maxunicode + 1))), bool, sys.maxunicode + 1)
    return cache["table"]


def _presence(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Presence rows (len(texts), DIM) and whether a text has a letter."""
    letters = _letters()
    codes = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    doc = np.repeat(np.arange(len(texts)), [len(c) for c in codes])
    flat = np.concatenate([np.zeros(0, np.uint32), *codes])
    is_letter = letters[flat]
    has = np.zeros(len(texts), bool)
    has[doc[is_letter]] = True
    flat = np.where(is_letter, flat, np.uint32(32))
    keep = np.ones(len(flat), bool)
    keep[1:] = is_letter[1:] | is_letter[:-1] | (doc[1:] != doc[:-1])
    flat, doc = flat[keep], doc[keep]
    rows = np.zeros((len(texts), DIM), bool)
    place = rows.ravel()
    h = np.zeros(len(flat), np.uint32)
    for n in range(1, max(GRAMS) + 1):
        size = len(flat) - n + 1
        if size <= 0:
            break
        h = (h[:size] + flat[n - 1:]) * np.uint32(0x9E3779B1) ^ np.uint32(n)
        if n in GRAMS:
            mixed = ((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - DIM.bit_length() + 1)
            same = doc[:size] == doc[n - 1:]
            place[(doc[:size] * DIM + mixed)[same]] = True
    return rows, has


def _batches(text: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) in runs of bounded size; null as empty."""
    out, size, start = [], 0, 0
    for i, t in enumerate(text):
        t = t.as_py() or ""
        out.append(t)
        size += len(t)
        if size >= _BATCH_CHARS or len(out) >= _BATCH_ROWS:
            yield start, out
            out, size, start = [], 0, i + 1
    if out:
        yield start, out


def _collect_presence(batches):
    for batch in batches:
        for start, texts in _batches(batch.column(1)):
            rows, has = _presence(texts)
            bits = [row.tobytes() for row in np.packbits(rows, axis=1)]
            out = pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), pa.array(bits, pa.binary())],
                                             names=["lang", "bits"])
            yield out.filter(pa.array(has))


class Model:
    """Languages, the DIM x languages weight matrix and the offsets."""

    def __init__(self, languages: list[str], weights: np.ndarray, offsets: np.ndarray):
        self.languages, self.weights, self.offsets = languages, weights, offsets

    def scores(self, rows: np.ndarray) -> np.ndarray:
        size = np.maximum(rows.sum(1, dtype=np.int64), 1)
        return (rows.astype(np.float32) @ self.weights) / np.sqrt(size)[:, None] + self.offsets


def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(lang, text): per language a bounded number of rows, the first in the
    order of a hash of the id.  A hash threshold set from the language's count
    cuts the rows before any are ranked, so a frequent language costs no more."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter(
        "lang is not null and text is not null")
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return rows.select("lang", "text")
    each = max(1, min(PER_LANGUAGE, MAX_TRAIN // len(counts)))
    share = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, 1.5 * each / n + 20 / n))])
    h = F.xxhash64("id", F.lit(11))
    few = rows.filter(F.pmod(h, F.lit(1 << 30)) < F.try_element_at(share, F.col("lang")) * (1 << 30))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(h, "id"))
    return few.withColumn("rank", rank).filter(F.col("rank") <= each).select("lang", "text")


def _unit_rows(bits: list[bytes]) -> np.ndarray:
    """Packed presence rows, each over the root of its size."""
    rows = np.unpackbits(np.frombuffer(b"".join(bits), np.uint8).reshape(len(bits), -1), axis=1)
    return rows.astype(np.float32) / np.sqrt(np.maximum(rows.sum(1, dtype=np.int64), 1)).astype(np.float32)[:, None]


def fit(sample: DataFrame) -> Model | None:
    """Model of a bounded sample (lang, text); None without a usable row."""
    found = sorted((r.lang, bytes(r.bits)) for r in sample.mapInArrow(_collect_presence, "lang string, bits binary").collect())
    if not found:
        return None
    languages = sorted({lang for lang, _ in found})
    label = np.array([languages.index(lang) for lang, _ in found])
    # every language gives landmarks in turn
    turn = np.concatenate([np.arange(n) for n in np.bincount(label)])
    marks = _unit_rows([found[i][1] for i in np.argsort(turn, kind="stable")[:LANDMARKS]])
    to_features = nystrom_map((marks @ marks.T).astype(np.float64))
    z = np.concatenate([_unit_rows([b for _, b in found[lo:lo + 256]]) @ marks.T for lo in range(0, len(found), 256)])
    z = z.astype(np.float64) @ to_features
    weights, offsets = ridge(z, np.eye(len(languages))[label], RIDGE * len(found))
    return Model(languages, (marks.T @ (to_features @ weights)).astype(np.float32), offsets)


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``lang_pred``, ``score`` (0 to 1).

    Texts that are null or without a letter give ``und`` with score 0; so does
    every text without a model.  The whole text is read.  Repeated rows and
    null ids are scored as they come; an empty table gives an empty result."""
    def run(batches):
        for batch in batches:
            for start, texts in _batches(batch.column(1)):
                rows, has = _presence(texts)
                if model is None:
                    names, value = ["und"] * len(texts), np.zeros(len(texts))
                else:
                    scores = model.scores(rows)
                    best = scores.argmax(1)
                    names = [model.languages[b] if ok else "und" for b, ok in zip(best, has)]
                    value = np.where(has, np.clip(scores.max(1), 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(texts)), pa.array(names, pa.string()), pa.array(value.astype(np.float64))],
                    names=["id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, lang_pred string, score double").withColumnRenamed("id", id_col)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False))
    model = fit(training_sample(docs.filter(~held_out), "doc_id", "text", "lang"))
    return identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
