"""Packing of documents into fixed windows by order-preserving dynamic
programming.

The token stream of a partition keeps the order of its rows.  A window is at
most ``window`` tokens; one whose length is a power of two needs no padding, any
other is padded to the full length.  Cuts are chosen at document ends (free) and
sentence ends (small penalty); a full window may also be cut inside a sentence
(larger penalty).  With cut positions c and ``f[j]`` the least cost of a prefix
that ends at c[j],

    f[j] = p(j) + min over k of (k-1)*p_mid + k*(window + p_win) - c[j]
                      + min of f[i] + c[i] over (k-1)*window < c[j] - c[i] <= k*window

so each k <= HOPS needs a sliding minimum, held in a monotone queue: the work is
linear in the number of cut positions.  Windows of a power of two are looked up
among the cut positions.  The stream is planned in blocks of ``BLOCK`` tokens;
the tail of a block is carried over, so memory does not grow with a partition.
"""

from __future__ import annotations

import sys
import types
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Penalties in tokens of padding: a cut at a sentence end, a cut inside a
#: sentence, and every window.
P_SENTENCE, P_MID, P_WIN = 2.0, 12.0, 4.0
#: Windows filled to the end in a row before a boundary must be used.
HOPS = 3
BLOCK = 1 << 18
_LONG_RUN = 20_000


def plan_cuts(at: list[int], penalty: list[float], window: int, last: bool) -> list[int]:
    """Window ends for a stream whose possible cuts are ``at`` (ascending, from
    0 to its length).  Without ``last`` the plan ends at the best cut within the
    final window, and the rest is left to the caller."""
    n = len(at)
    pos = np.asarray(at)
    hits: dict[int, list[int]] = {}
    for m in range(window.bit_length() - 1):
        found = np.searchsorted(pos, pos - (1 << m))
        ok = np.flatnonzero((pos >= 1 << m) & (pos[np.minimum(found, n - 1)] == pos - (1 << m)))
        for j, i in zip(ok.tolist(), found[ok].tolist()):
            hits.setdefault(j, []).append(i)
    f, back = [0.0] * n, [(0, 0)] * n
    key = [0.0] * n  # f[i] + at[i]
    queues = [deque() for _ in range(HOPS)]
    enter = [0] * HOPS
    for j in range(1, n):
        here, best, choice = at[j], float("inf"), (0, 0)
        for k in range(HOPS):
            q, e, low, high = queues[k], enter[k], here - k * window, here - (k + 1) * window
            while e < j and at[e] < low:
                value = key[e]
                while q and key[q[-1]] >= value:
                    q.pop()
                q.append(e)
                e += 1
            enter[k] = e
            while q and at[q[0]] < high:
                q.popleft()
            if q:
                cost = key[q[0]] + k * P_MID + (k + 1) * (window + P_WIN) - here
                if cost < best:
                    best, choice = cost, (q[0], k)
        for i in hits.get(j, ()):
            if f[i] + P_WIN < best:
                best, choice = f[i] + P_WIN, (i, 0)
        f[j] = best + penalty[j]
        key[j] = f[j] + here
        back[j] = choice
    j = n - 1
    if not last:
        j = min(range(int(np.searchsorted(pos, max(1, at[-1] - window))), n), key=lambda i: (f[i], i))
    cuts = []
    while j > 0:
        i, k = back[j]
        cuts.append(at[j])
        cuts.extend(at[i] + h * window for h in range(k, 0, -1))
        j = i
    return cuts[::-1]


class Stream:
    """Tokens of a partition that are not yet packed."""

    def __init__(self, window: int, first_sequence: int, ends_sentence: np.ndarray):
        self.window, self.sequence, self.ends = window, first_sequence, ends_sentence
        self.docs: list[tuple] = []  # (doc_id, tokens, tokens already packed)
        self.size = 0

    def add(self, doc_id, ids: np.ndarray):
        self.docs.append((doc_id, ids, 0))
        self.size += len(ids)

    def flush(self, last: bool) -> list[tuple]:
        """Pieces (doc_id, start, tokens, doc_tokens, sequence, offset)."""
        if not self.docs:
            return []
        ids = np.concatenate([d[1][d[2]:] for d in self.docs])
        doc_end = np.cumsum([len(d[1]) - d[2] for d in self.docs])
        cost = np.full(len(ids) + 1, np.inf)
        cost[1:][self.ends[ids]] = P_SENTENCE
        cost[doc_end] = 0
        cost[0] = 0
        at = np.flatnonzero(np.isfinite(cost))
        gaps = np.flatnonzero(np.diff(at) > (HOPS - 1) * self.window)
        if len(gaps):  # long runs without a boundary
            more = [np.arange(at[g] + self.window, at[g + 1], self.window) for g in gaps]
            at = np.sort(np.concatenate([at, *more]))
            cost[np.isinf(cost)] = P_MID
        cuts = plan_cuts(at.tolist(), cost[at].tolist(), self.window, last)
        done = cuts[-1]
        edges = np.unique(np.concatenate([[0], cuts, doc_end[doc_end < done]]))
        doc = np.searchsorted(doc_end, edges[:-1], "right")
        win = np.searchsorted(cuts, edges[:-1], "right")
        begin = np.concatenate([[0], cuts])
        doc_begin = np.concatenate([[0], doc_end])
        out = []
        for a, b, d, s in zip(edges[:-1].tolist(), edges[1:].tolist(), doc.tolist(), win.tolist()):
            doc_id, whole, before = self.docs[d]
            start = before + a - int(doc_begin[d])
            out.append((doc_id, start, whole[start:start + b - a], len(whole), self.sequence + s, a - int(begin[s])))
        self.sequence += len(cuts)
        self.size -= done
        left = int(np.searchsorted(doc_end, done, "right"))
        rest = self.docs[left:]
        if rest:
            doc_id, whole, before = rest[0]
            rest[0] = (doc_id, whole, before + done - int(doc_begin[left]))
        self.docs = rest
        return out


def _encoder(tokenizer_path: str, ranks_path: str | None, pattern: str | None):
    """(encode, ends_sentence) of this worker process, loaded once.  With the
    same vocabulary as ranks, ordinary texts take the faster library; texts that
    spell a special token or hold a very long unbroken run take the first, which
    is loaded only then."""
    cache = sys.modules.setdefault("_llm_encoders", types.ModuleType("_llm_encoders")).__dict__
    key = (tokenizer_path, ranks_path)
    if key in cache:
        return cache[key]
    loaded = []

    def slow():
        if not loaded:
            from tokenizers import Tokenizer
            loaded.append(Tokenizer.from_file(tokenizer_path))
        return loaded[0]

    def whole(text: str) -> list[int]:
        return slow().encode(text, add_special_tokens=False).ids

    if ranks_path:
        import base64
        import json

        import tiktoken
        with open(ranks_path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        with open(tokenizer_path, encoding="utf-8") as file:
            special = [t["content"] for t in json.load(file)["added_tokens"]]
        fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        ends = np.zeros(max(ranks.values()) + 1 + len(special), bool)
        for token, i in ranks.items():
            ends[i] = token[-1:] in b".!?\n"

        def encode(text: str) -> list[int]:
            if any(s in text for s in special) or len(text) > _LONG_RUN and max(map(len, text.split()), default=0) > _LONG_RUN:
                return whole(text)
            return fast.encode_ordinary(text)
    else:
        encode, vocab = whole, slow().get_vocab()
        ends = np.zeros(max(vocab.values(), default=0) + 1, bool)
        for token, i in vocab.items():
            ends[i] = token[-1:] in ".!?Ċ"  # U+010A stands for a newline

    cache[key] = encode, ends
    return cache[key]


def pack(docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, pattern: str | None = None,
         id_col: str = "doc_id", text_col: str = "text", window: int = 1024, end_id: int = 0,
         with_ids: bool = False) -> DataFrame:
    """Pieces of documents in windows: id, ``start`` (tokens of its document
    before it), ``length``, ``ids_crc32`` (little-endian 32-bit ids),
    ``doc_tokens``, ``sequence_id``, ``offset`` and, on request, the ``ids``.

    Rows keep the order they have in their partition: sort the input to impose
    one.  There is no shuffle; sequence ids hold the partition in their upper
    bits.  A null text is empty and gives the end token alone; repeated rows
    and null ids are packed as they come; an empty table gives an empty
    result."""
    def run(batches):
        encode, ends = _encoder(tokenizer_path, ranks_path, pattern)
        stream = Stream(window, TaskContext.get().partitionId() << 40, ends)

        def rows(pieces):
            cols = list(zip(*pieces)) or [()] * 6
            toks = cols[2]
            arrays = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(map(len, toks), pa.int64()),
                      pa.array([zlib.crc32(t) for t in toks], pa.int64()), *(pa.array(c, pa.int64()) for c in cols[3:])]
            names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                at = np.cumsum([0, *map(len, toks)]).astype(np.int32)
                flat = np.concatenate([np.zeros(0, "<u4"), *toks]).view(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(at), pa.array(flat)))
                names.append("ids")
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "")
                ids.append(end_id)
                stream.add(doc_id, np.array(ids, "<u4"))
                if stream.size >= BLOCK:
                    yield rows(stream.flush(last=False))
        yield rows(stream.flush(last=True))

    schema = ("id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
              + ", ids array<int>" * with_ids)
    pieces = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
    return pieces.withColumnRenamed("id", id_col)


def packed_bpe(docs: DataFrame, **options) -> DataFrame:
    """``pack`` with the public 50k byte-level BPE vocabulary."""
    import public_tokenizers as public
    return pack(docs, public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN, **options)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_bpe(spark.read.parquet(f"{sf_dir}/documents.parquet"))
