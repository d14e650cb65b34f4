"""Vectorised word, shingle and MinHash arithmetic over Arrow string columns.

Every function works on the UTF-8 bytes of a whole batch at once, so a task never loops over words in
Python. Texts are handled whole; a batch is only cut between documents.

A *word* is a maximal run of bytes other than space and ``\\t\\n\\v\\f\\r`` inside one document. Null texts
count as empty. Hashes depend only on the bytes, so they agree between tasks, runs and machines.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def random_words(seed: int, n: int) -> np.ndarray:
    """n reproducible 64-bit numbers."""
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, n, dtype=np.uint64)


_BYTE_VALUE = random_words(11, 256) | np.uint64(1)
_powers = np.ones((2, 1), np.uint64)


def powers(n: int) -> np.ndarray:
    """Row 0: powers of an odd number modulo 2^64, row 1: their inverses; at least n of each."""
    global _powers
    if _powers.shape[1] < n:
        size = max(n, 2 * _powers.shape[1], CHUNK_BYTES + 1)
        _powers = np.ones((2, size), np.uint64)
        for row, base in zip(_powers, (_ODD, _ODD_INVERSE), strict=True):
            row[1:] = base
            np.cumprod(row, out=row)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads all bits of 64-bit numbers over all bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


@dataclass
class Texts:
    """Consecutive documents: their bytes, and where each one starts (one more entry than documents)."""

    data: np.ndarray
    offsets: np.ndarray
    first_row: int

    def __len__(self) -> int:
        return len(self.offsets) - 1


def string_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, where, what = column.buffers()
    if not len(column) or where is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(what, np.uint8)[offsets[0] : offsets[-1]] if what is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[Texts]:
    """Runs of whole documents of about ``limit`` bytes; a longer document is a run of its own."""
    data, offsets = string_bytes(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(n, max(row + 1, end))
        yield Texts(data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row], row)
        row = end


def word_bounds(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each document (and past the last) the index of its first word."""
    n = len(texts.data)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(texts.offsets), np.int64)
    space = SPACE[texts.data]
    before = np.ones(n, bool)
    before[1:] = space[:-1]
    before[texts.offsets[:-1][texts.offsets[:-1] < n]] = True
    after = np.ones(n, bool)
    after[:-1] = space[1:]
    after[texts.offsets[1:][texts.offsets[1:] > 0] - 1] = True
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(starts, texts.offsets)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums from which span_hash() gets the hash of any span of the bytes."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[data] * powers(len(data) + 1)[0, : len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans; equal bytes give equal hashes wherever they stand."""
    return mix((prefix[ends] - prefix[starts]) * powers(len(prefix))[1][starts])


def word_hashes(texts: Texts, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and for each document (and past the last) the index of its first word."""
    if lower:
        texts = Texts(LOWER[texts.data], texts.offsets, texts.first_row)
    starts, ends, firsts = word_bounds(texts)
    return span_hash(prefix_hash(texts.data), starts, ends), firsts


_PLACE = random_words(12, 64) | np.uint64(1)


def shingles(words: np.ndarray, firsts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words of each document, and the index of each document's first.

    A document of fewer words has one shingle, the whole sequence; one without words has none.
    """
    n = np.diff(firsts)
    counts = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    where = np.zeros(len(firsts), np.int64)
    np.cumsum(counts, out=where[1:])
    out = np.zeros(where[-1], np.uint64)
    doc = np.repeat(np.arange(len(n)), n)
    if len(words) >= k:
        total = np.zeros(len(words) - k + 1, np.uint64)
        for j in range(k):
            total += words[j : len(words) - k + 1 + j] * _PLACE[j]
        inside = np.flatnonzero(doc[: len(total)] == doc[k - 1 :])
        out[where[doc[inside]] + inside - firsts[doc[inside]]] = mix(total[inside])
    for d in np.flatnonzero((n > 0) & (n < k)):
        own = words[firsts[d] : firsts[d + 1]]
        out[where[d]] = mix((own * _PLACE[: len(own)]).sum(keepdims=True, dtype=np.uint64) + _PLACE[32 + len(own) % 32])[0]
    return out, where


def distinct(values: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each document in ascending order, and the index of each document's first."""
    values = values.copy()
    for a, b in zip(firsts[:-1], firsts[1:], strict=True):
        if b - a > 1:
            values[a:b].sort()
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    keep[firsts[:-1][firsts[:-1] < len(values)]] = True
    where = np.zeros(len(firsts), np.int64)
    where[1:] = np.cumsum(keep)[firsts[1:] - 1] if len(values) else 0
    where[1:][firsts[1:] == 0] = 0
    return values[keep], where


def per_document(ufunc: np.ufunc, values: np.ndarray, firsts: np.ndarray, empty) -> np.ndarray:
    """ufunc.reduce over each document's values; ``empty`` for documents without any."""
    out = np.full(len(firsts) - 1, empty, values.dtype)
    full = firsts[1:] > firsts[:-1]
    if full.any():
        out[full] = ufunc.reduceat(values, firsts[:-1][full])
    return out


def minhash(values: np.ndarray, firsts: np.ndarray, n_hashes: int, seed: int = 21) -> np.ndarray:
    """The minima of n_hashes multiply-add hash functions over each document's values: [document, function]."""
    factors, shifts = random_words(seed, n_hashes) | np.uint64(1), random_words(seed + 1, n_hashes)
    out = np.empty((n_hashes, len(firsts) - 1), np.uint64)
    for i in range(n_hashes):
        out[i] = per_document(np.minimum, values * factors[i] + shifts[i], firsts, np.uint64(2**64 - 1))
    return (out.T >> np.uint64(32)).astype(np.uint32)


def in_sorted(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """For each value its position in an ascending array, or -1."""
    if not len(ordered):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return np.where(ordered[at] == values, at, -1)


class Lookup:
    """Positions in an ascending array of hashes; a bit table answers most misses."""

    def __init__(self, ordered: np.ndarray, bits: int = 21):
        self.ordered, self.shift = ordered, np.uint64(64 - bits)
        self.maybe = np.zeros(1 << bits, bool)
        self.maybe[(ordered >> self.shift).astype(np.int64)] = True

    def hits(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the values that are in the array, and their positions there."""
        some = np.flatnonzero(self.maybe[(values >> self.shift).astype(np.int64)])
        at = in_sorted(values[some], self.ordered)
        found = at >= 0
        return some[found], at[found]
