"""Vectorised words of Arrow text columns, for use inside Arrow tasks.

A word is a run of bytes outside 0x20 and 0x09-0x0D.  Work goes slice by slice
(1 MB of text), so memory does not grow with the batch; a single text
larger than a slice is one slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SLICE_BYTES = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """Words of the texts of one slice.  ``keys``: a 64-bit hash per word;
    ``first[i]:first[i + 1]``: the words of text i; ``data``/``at``: the words'
    bytes back to back and where each begins."""

    def __init__(self, rows: slice, keys, first, data, at):
        self.rows, self.keys, self.first, self.data, self.at = rows, keys, first, data, at

    def joined(self, i: int, keep: np.ndarray | None = None) -> bytes:
        """The (kept) words of text i, joined by one space."""
        a, b = int(self.first[i]), int(self.first[i + 1])
        at, data = self.at, self.data
        return b" ".join([data[at[k]:at[k + 1]] for k in range(a, b) if keep is None or keep[k - a]])

    def joined_all(self, i: int) -> bytes:
        """``joined`` without a selection, by one vectorised copy."""
        a, b = int(self.first[i]), int(self.first[i + 1])
        if a == b:
            return b""
        at = self.at[a:b + 1] - self.at[a]
        out = np.full(int(at[-1]) + b - a - 1, 0x20, np.uint8)
        step = np.zeros(int(at[-1]), np.int64)
        step[at[1:-1]] = 1
        out[np.arange(int(at[-1])) + np.cumsum(step)] = np.frombuffer(self.data, np.uint8, int(at[-1]), int(self.at[a]))
        return out.tobytes()


def slices(text: pa.Array, lower: bool = False) -> Iterator[Words]:
    """``Words`` of consecutive runs of texts; a null text has no words."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    n = len(text)
    if n == 0:
        return
    wide = np.int64 if pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type) else np.int32

    def offsets(array):     # the batch's own; its bytes are not copied
        return np.frombuffer(array.buffers()[1], wide)[array.offset:array.offset + n + 1].astype(np.int64)
    off = offsets(text)
    if text.null_count and np.diff(off)[text.is_null().to_numpy(zero_copy_only=False)].any():
        text = text.fill_null("")
        off = offsets(text)
    raw = text.buffers()[2]
    buf = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + SLICE_BYTES, "right")) - 1)
        yield _split(slice(lo, hi), buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], lower)
        lo = hi


def _split(rows: slice, buf: np.ndarray, off: np.ndarray, lower: bool) -> Words:
    inside = ~_SPACE[buf]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cut = off[(off > 0) & (off < len(buf))]
    begins[cut] = inside[cut]  # a text starts a new word
    starts = np.flatnonzero(begins)
    data = buf[inside]
    if lower:
        data = _LOWER[data]
    data = data.tobytes()
    at = np.append(np.cumsum(inside)[starts] - 1 if len(starts) else [], len(data)).astype(np.int64)
    first = np.searchsorted(starts, off)
    if len(starts) == 0:
        return Words(rows, np.zeros(0, np.uint64), first, data, at)
    arr = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(data)])
    coded = arr.dictionary_encode()
    table = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return Words(rows, table[coded.indices.to_numpy()], first, data, at)


def _mix(x: np.ndarray) -> np.ndarray:
    """A finaliser over uint64 (wraps around), so that all bits of a rolling
    sum reach all bits of the result."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def window_hashes(keys: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """Hash of ``keys[i:i + length]`` for every i with a whole window: powers
    of an odd multiplier over the window, by binary doubling of the length."""
    n = len(keys) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = 0x9E3779B97F4A7C55 + 2 * 0x51ED2701 * seed
    level, size = _mix(keys ^ np.uint64(0xA0761D6478BD642F * (seed + 1) % 2**64)), 1
    out, done, rest = None, 0, length
    while rest:
        if rest & 1:
            part = level[done:done + n]
            out = part.copy() if out is None else out * np.uint64(pow(base, size, 2**64)) + part
            done += size
        rest >>= 1
        if rest:
            level = level[:-size] * np.uint64(pow(base, size, 2**64)) + level[size:]
            size *= 2
    return _mix(out)
