"""Toxicity by a subsequence string-kernel support vector machine.

Two terms are alike when they share character subsequences of length 3 or 4; a
subsequence may skip up to two characters and counts ``DECAY`` per skipped one,
so spellings with one or two inserted characters ("id*iot") stay close to the
plain one.  Where more is inserted ("i.d.i.o.t", "i--d--i--o--t", "ixdxixoxt")
the kernel is too narrow; such a term is scored in further forms as well (see
``_forms``) and its highest form counts.  Nyström landmarks give the feature map of the SVM.  As its decision is
linear in the kernel with the landmarks, their weights are added up into one
weight per subsequence, which scores a term by lookups alone.

Labels are of documents (or sentences: any labelled text), while a few terms
make a text toxic.  Training therefore picks witness terms: greedily those that
explain the most toxic texts not yet explained and hardly occur in clean ones.
The SVM learns witnesses against terms of clean texts, of which the hardest are
mined in a second round.  A text's score is a logistic function of its two
highest-scoring distinct terms.

Spark counts the terms of the sample, mines and scores; the driver holds only
the bounded tables named below.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, stage
from .kernel import logistic, nystrom_map, svm
from .words import slices

#: Bounds of training: labelled texts per class, candidate witnesses, clean
#: terms (random, and mined), landmarks.  The driver holds at most
#: PER_CLASS * CANDIDATES (text, term) pairs, and far fewer in practice.
PER_CLASS, CANDIDATES, CLEAN_TERMS, MINED, LANDMARKS = 2500, 2000, 2500, 1500, 256
DECAY = 0.5
TABLE = 1 << 22
THRESHOLD = 0.7
_TERM, _STEP = 40, 20  # longer terms are scored by overlapping pieces
_FLOOR = -3.0
_CHARS = 100_000  # characters of terms scored at once
_PATTERNS = [(3, (0, b, c)) for b in range(1, 4) for c in range(b + 1, min(b + 3, 5) + 1) if c <= 4] + \
            [(4, (0, b, c, d)) for b in range(1, 4) for c in range(b + 1, 5) for d in range(c + 1, 6) if d <= 5]
_SPACED = re.compile(rb"(?<![^\x09-\x0d\x20])(?:[^\x09-\x0d\x20][\x09-\x0d\x20]){2,}[^\x09-\x0d\x20](?![^\x09-\x0d\x20])")
_TRIM = " \t\n\r\f\v.,;:!?\"'()[]{}<>|*#$%&+=/\\~^`_-"


def _letters(term: str) -> str:
    """A term without inserted signs and digits, however many."""
    return term if term.isalpha() else "".join(filter(str.isalpha, term))


def _forms(term: str) -> set[str]:
    """A term as written, its letters alone, and every second and every third
    character from each start: one or two characters of any kind, letters too,
    put between all letters."""
    forms = {term[start::step] for step in (2, 3) for start in range(step)} if len(term) > 6 else set()
    return {term} | {f for f in forms if len(f) >= 4} | {f for f in (_letters(term),) if len(f) >= 3}


def _pieces(terms: list[str]) -> tuple[list[str], list[int]]:
    """All forms of the terms, long ones in overlapping pieces, and whose they are."""
    pieces, owner = [], []
    for i, term in enumerate(terms):
        for form in _forms(term):
            cut = [form] if len(form) <= _TERM else [form[j:j + _TERM] for j in range(0, len(form) - _STEP, _STEP)]
            pieces += cut
            owner += [i] * len(cut)
    return pieces, owner


def _runs(terms: list[str]):
    """Bounds of runs of terms with about ``_CHARS`` characters."""
    ends = np.cumsum(np.fromiter(map(len, terms), np.int64, len(terms)))
    lo = 0
    while lo < len(terms):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + _CHARS, "right")))
        yield lo, hi
        lo = hi


def _by_pattern(terms: list[str]):
    """Per pattern of positions: terms, places and the weight of the gapped
    subsequences of that pattern.  One pattern at a time keeps memory at a few
    arrays of the terms' characters."""
    size = np.fromiter(map(len, terms), np.int64, len(terms))
    codes = np.frombuffer("".join(terms).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(terms), dtype=np.int32), size)
    left = (np.repeat(np.cumsum(size), size) - np.arange(len(codes))).astype(np.int32)  # characters to the term's end
    for p, offsets in _PATTERNS:
        at = np.flatnonzero(left > offsets[-1])
        h = np.full(len(at), p, np.uint32)
        for o in offsets:
            h = (h + codes[at + o]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        h = (h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - TABLE.bit_length() + 1)
        yield owner[at], h, DECAY ** (offsets[-1] - p + 1)


def _features(terms: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term, place, weight) of all gapped subsequences of a few terms."""
    parts = [(owner, place, np.full(len(place), weight, np.float32)) for owner, place, weight in _by_pattern(terms)]
    return tuple(np.concatenate(x) for x in zip(*parts))


def _norms(terms: list[str]) -> np.ndarray:
    """Root of a term's self-similarity, its subsequences taken as distinct; a
    function of the length alone."""
    longest = max(map(len, terms), default=0)
    square = np.zeros(longest + 1)
    for p, offsets in _PATTERNS:
        square += np.maximum(np.arange(longest + 1) - offsets[-1], 0) * DECAY ** (2 * (offsets[-1] - p + 1))
    return np.sqrt(np.maximum(square, 1e-9))[np.fromiter(map(len, terms), np.int64, len(terms))]


def gram(a: list[str], b: list[str]) -> np.ndarray:
    """Kernel matrix of two lists of terms."""
    term_b, place_b, weight_b = _features(b)
    places, column = np.unique(place_b, return_inverse=True)
    table = np.zeros((len(places) + 1, len(b)))
    np.add.at(table, (column, term_b), weight_b)
    out = np.zeros((len(a), len(b)))
    for lo in range(0, len(a), 500):
        part = a[lo:lo + 500]
        term, place, weight = _features(part)
        at = np.searchsorted(places, place)
        at[(at == len(places)) | (places[np.minimum(at, len(places) - 1)] != place)] = len(places)
        known = at < len(places)
        np.add.at(out, lo + term[known], table[at[known]] * weight[known, None])
    return out / (_norms(a)[:, None] * _norms(b))


class Model:
    """Weights per subsequence place, offset of the SVM and the logistic
    function over (highest, second highest) term."""

    def __init__(self, places, weights, offset, curve=None):
        self.places, self.weights, self.offset, self.curve = places, weights, offset, curve

    def plain(self, pieces: list[str], table: np.ndarray) -> np.ndarray:
        """Margins of terms (not longer than ``_TERM``) as they are written."""
        value = np.zeros(len(pieces))
        for term, place, weight in _by_pattern(pieces):
            value += weight * np.bincount(term, table[place], len(pieces))
        return value / _norms(pieces) + self.offset

    def margins(self, terms: list[str], table: np.ndarray) -> np.ndarray:
        """Margins of terms: the highest of their forms, a bounded number of
        characters at a time."""
        out = np.full(len(terms), _FLOOR)
        for lo, hi in _runs(terms):
            pieces, owner = _pieces(terms[lo:hi])
            np.maximum.at(out, lo + np.array(owner, np.int64), np.maximum(self.plain(pieces, table), _FLOOR))
        return out

    def table(self) -> np.ndarray:
        table = np.zeros(TABLE, np.float32)
        table[self.places] = self.weights
        return table


def fit_terms(good: list[str], bad: list[str]) -> Model:
    """SVM of toxic (``bad``) against clean terms."""
    terms = bad + good
    y = np.r_[np.ones(len(bad)), -np.ones(len(good))]
    step = max(1, len(good) // max(1, LANDMARKS - min(len(bad), LANDMARKS // 2)))
    marks = bad[:LANDMARKS // 2] + good[::step]
    marks = marks[:LANDMARKS]
    to_features = nystrom_map(gram(marks, marks))
    z = gram(terms, marks) @ to_features
    cost = np.where(y > 0, 10.0 * max(1.0, len(good) / max(1, len(bad)) / 10), 10.0)
    w, offset = svm(z, y, cost)
    term, place, weight = _features(marks)
    alpha = (to_features @ w) / _norms(marks)
    places, at = np.unique(place, return_inverse=True)
    return Model(places, np.bincount(at, alpha[term] * weight, len(places)).astype(np.float32), offset)


def _join_spaced(text: bytes | None) -> bytes | None:
    """Runs of single characters become one term ("i d i o t")."""
    return _SPACED.sub(lambda m: b"".join(m[0].split()), text) if text else text


def _terms(text: pa.Array):
    """Per slice: (rows, distinct terms, term of every word, first word of every
    text); a few hundred texts at a time, so a large batch is not held twice."""
    for lo in range(0, len(text), 500):
        part = pa.array(map(_join_spaced, text.slice(lo, 500).cast(pa.binary()).to_pylist()), pa.binary()).cast(pa.string())
        for words in slices(part, lower=True):
            _, index, inverse = np.unique(words.keys, return_index=True, return_inverse=True)
            terms = [words.data[words.at[i]:words.at[i + 1]].decode().lower() for i in index]
            rows = slice(lo + words.rows.start, lo + words.rows.stop)
            yield rows, [t.strip(_TRIM) or t[:_TERM] for t in terms], inverse, words.first


def _two_highest(margins: np.ndarray, inverse: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per text, the highest and second highest margin of its distinct terms."""
    out = np.full((len(first) - 1, 2), _FLOOR)
    full = np.flatnonzero(np.diff(first) > 0)
    if len(full) == 0:
        return out
    order = np.argsort(margins, kind="stable")
    rank = np.empty(len(margins), np.int64)
    rank[order] = np.arange(len(margins))
    value = rank[inverse]
    top = np.maximum.reduceat(value, first[full])
    rest = np.where(value == np.repeat(top, np.diff(first)[full]), -1, value)
    second = np.maximum.reduceat(rest, first[full])
    out[full, 0] = margins[order[top]]
    out[full, 1] = np.where(second >= 0, margins[order[second]], _FLOOR)
    return out


def _emit_terms(batches):
    """Every term of a text once, and once the letters alone of its terms, so that all
    spellings with inserted signs count for one term."""
    for batch in batches:
        for rows, terms, inverse, first in _terms(batch.column(2)):
            doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
            code: dict[str, int] = {}
            both = np.array([[code.setdefault(f, len(code)) for f in (t, _letters(t))] for t in terms], np.int64).reshape(-1, 2)
            pair = np.unique(doc[:, None] * len(code) + both[inverse])
            row = pa.array(rows.start + pair // max(1, len(code)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(row), batch.column(1).take(row), pa.array(list(code), pa.string()).take(pa.array(pair % max(1, len(code))))],
                names=["id", "toxic", "term"])


def _emit_margins(model: Model):
    def run(batches):
        table = model.table()
        for batch in batches:
            for rows, terms, inverse, first in _terms(batch.column(1)):
                two = _two_highest(model.margins(terms, table), inverse, first)
                n = len(first) - 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(rows.start, n), pa.array(two[:, 0]), pa.array(two[:, 1])], names=["id", "a", "b"])
    return run


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> tuple[DataFrame, dict]:
    """Staged (id, toxic, text) of at most ``PER_CLASS`` texts per class, the
    first by a hash of the id, without repeated texts; and all counts."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).filter(
        "id is not null and toxic in (0, 1)").groupBy("id").agg(F.max("toxic").alias("toxic"))
    known = stage(known, "labels")
    counts = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    ids = [known.filter(F.col("toxic") == t).orderBy(F.xxhash64("id", F.lit(5)), "id").limit(PER_CLASS) for t in (0, 1)]
    ids = F.broadcast(ids[0].union(ids[1]))  # at most two classes of PER_CLASS ids
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null").join(ids, "id")
    one = texts.groupBy("text").agg(F.max(F.struct("toxic", "id")).alias("top"))   # of equal texts the toxic label counts
    return stage(one.select("top.id", "top.toxic", "text"), "sample"), counts


def _witnesses(pairs: list[tuple[str, int]], total: int) -> list[str]:
    """Greedy cover: terms that explain the most texts which have fewer than
    two witnesses so far, until a term explains under half a percent (or 3)."""
    texts = defaultdict(set)
    for term, doc in pairs:
        texts[term].add(doc)
    have, chosen, least = Counter(), [], max(3, total // 200)
    gain = {t: len(d) for t, d in texts.items()}
    while gain:
        best = max(gain, key=lambda t: (gain[t], t))
        now = sum(have[d] < 2 for d in texts[best])
        if now < gain[best]:
            gain[best] = now
            if now < least:
                del gain[best]
            continue
        if now < least:
            break
        chosen.append(best)
        have.update(texts[best])
        del gain[best]
    return chosen


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic") -> Model | None:
    """Model of a bounded labelled sample; None when there are no toxic or no
    clean texts to learn from, or no term tells them apart."""
    sample, counts = labelled_sample(docs, labels, id_col, text_col, label_col)
    sizes = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return None
    seen = stage(sample.select("id", "toxic", "text").mapInArrow(_emit_terms, "id long, toxic int, term string")
                 .filter(F.length("term").between(3, _TERM)), "terms")
    stats = stage(seen.groupBy("term").agg(F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg")), "stats")
    least = max(3, toxic // 200)
    odds = (F.col("pos") + 0.5) / (toxic + 1) / ((F.col("neg") + 0.5) / (clean + 1))
    cand = stats.filter((F.col("pos") >= least) & (odds >= 10)).orderBy(F.desc("pos"), "term").limit(CANDIDATES)
    cand = stage(cand.select("term"), "candidates")
    pairs = seen.filter("toxic = 1").join(F.broadcast(cand), "term").select("term", "id").distinct().collect()
    bad = _witnesses([(r.term, r.id) for r in pairs], toxic)
    if not bad:
        return None
    negative = stats.filter("neg > 0 and pos <= neg")
    good = [r.term for r in negative.orderBy(F.xxhash64("term"), "term").limit(CLEAN_TERMS).collect()]
    model = fit_terms(good, bad)
    hard = negative.select("term").mapInArrow(_rank_terms(model), "term string, m double")
    hard = hard.join(F.broadcast(sample.sparkSession.createDataFrame([(t,) for t in bad], "term string")), "term", "left_anti")
    hard = [r.term for r in hard.dropDuplicates(["term"]).orderBy(F.desc("m"), "term").limit(MINED).collect()]
    model = fit_terms(sorted(set(good) | set(hard)), bad)
    two = sample.select("id", "text").mapInArrow(_emit_margins(model), "id long, a double, b double")
    rows = two.join(sample.select("id", "toxic"), "id").select("a", "b", "toxic").collect()
    x, y = np.array([(r.a, r.b) for r in rows]), np.array([float(r.toxic) for r in rows])
    share = np.where(y > 0, counts[1] / y.sum(), counts[0] / (1 - y).sum()) / (counts[0] + counts[1]) * len(y)
    model.curve = logistic(x, y, share)
    return model


def _rank_terms(model: Model):
    """All forms of the terms with their margins."""
    def run(batches):
        table = model.table()
        for batch in batches:
            terms = batch.column(0).to_pylist()
            for lo, hi in _runs(terms):
                pieces = sorted(set(_pieces(terms[lo:hi])[0]))
                yield pa.RecordBatch.from_arrays([pa.array(pieces, pa.string()), pa.array(model.plain(pieces, table))], names=["term", "m"])
    return run


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text",
          threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: id, ``score`` (0 to 1) and ``predicted`` (1
    from the threshold on).

    The whole text is read.  Null and empty texts score as a text without any
    suspicious term; without a model every score is 0.  Repeated rows and null
    ids are scored as they come; an empty table gives an empty result."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    if model is None:
        value, out = F.lit(0.0), rows
    else:
        out = rows.mapInArrow(_emit_margins(model), "id long, a double, b double")
        u, v, c = map(float, model.curve)
        value = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), u * F.col("a") + v * F.col("b") + c))))
    return out.select(F.col("id").alias(id_col), value.alias("score"), (value >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model | None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with their columns, that score below the
    threshold."""
    if model is None:
        return docs
    place = docs.columns.index(text_col)
    line = float(np.log(threshold / (1 - threshold)))

    def run(batches):
        table = model.table()
        for batch in batches:
            two = [_two_highest(model.margins(terms, table), inverse, first) for _, terms, inverse, first in _terms(batch.column(place))]
            if two:
                yield batch.filter(pa.array(np.concatenate(two) @ model.curve[:2] + model.curve[2] < line))

    return docs.mapInArrow(run, docs.schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, labels.filter(crc_mod(F.col("doc_id"), 3) != 1))
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")
