"""Word and n-gram hashing over Arrow string buffers, shared by the text operators.

A *word* is a maximal run of bytes that are neither ASCII white space, ASCII
control characters nor ASCII punctuation; ASCII and Latin-1 capitals count as
their small letters. Everything is a numpy pass over the UTF-8 bytes of many
documents at once, so no per-document Python work is needed. Hashes are 64-bit
and depend only on the words, never on the batch they come in.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text that are hashed at a time; bounds memory, doesn't change any hash.
PIECE = 1 << 20
_P = U(0x9E3779B97F4A7C15)
_PINV = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U)
    out[0] = U(1)
    return np.multiply.accumulate(out)


_TABLE = np.arange(256, dtype=np.uint8)
for _b in range(128):
    if not chr(_b).isalnum():
        _TABLE[_b] = 0
    elif chr(_b).isupper():
        _TABLE[_b] = _b + 32
_VALUES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.int64).astype(U) | U(1)
_pow: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _pow or len(_pow["p"]) < n:
        n = max(n, PIECE + 64)
        _pow["p"], _pow["i"] = _powers(_P, n), _powers(_PINV, n)
    return _pow["p"], _pow["i"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; a null is an empty text."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]] if len(offsets) else raw, offsets - offsets[0]


class Words:
    """The words of some documents: hash, byte range and document of each."""

    __slots__ = ("hash", "start", "end", "first", "n_docs", "low")

    def __init__(self, hash_: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, low: np.ndarray | None = None):
        self.hash, self.start, self.end, self.first, self.low = hash_, start, end, first, low
        self.n_docs = len(first) - 1

    def prefix(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Which words have n bytes (7 at most) or more, and a key of their first n."""
        at = np.flatnonzero(self.end - self.start >= n)
        key = np.full(len(at), n << 56, U)
        for j in range(n):
            key |= self.low[self.start[at] + j].astype(U) << U(8 * j)
        return at, mix(key)

    def doc(self) -> np.ndarray:
        """Index of each word's document."""
        return np.repeat(np.arange(self.n_docs), np.diff(self.first))


def words(raw: np.ndarray, offsets: np.ndarray) -> Words:
    """Hash every word; ``first[i]:first[i+1]`` are the words of document i."""
    if not len(raw):
        z = np.zeros(0, np.int64)
        return Words(np.zeros(0, U), z, z, np.zeros(len(offsets), np.int64), raw)
    t = _TABLE[raw]
    latin = np.flatnonzero(raw[:-1] == 0xC3) + 1
    b = raw[latin]
    latin = latin[(b >= 0x80) & (b <= 0x9E) & (b != 0x97)]
    t[latin] = raw[latin] + 32
    inside = np.zeros(len(t) + 2, np.bool_)
    np.not_equal(t, 0, out=inside[1:-1])
    begins = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(t))]
    begins[cuts] |= inside[1:-1][cuts]
    ends[cuts - 1] |= inside[1:-1][cuts - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    del inside, begins, ends
    out = np.empty(len(start), U)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(start):
            to = max(at + 1, int(np.searchsorted(end, start[at] + PIECE, side="right")))
            lo, hi = int(start[at]), int(end[to - 1])
            p, inv = _tables(hi - lo + 1)
            prefix = np.empty(hi - lo + 1, U)
            prefix[0] = 0
            values = _VALUES[t[lo:hi]]
            values *= p[: hi - lo]
            np.cumsum(values, out=prefix[1:])
            del values
            s, e = start[at:to] - lo, end[at:to] - lo
            out[at:to] = (prefix[e] - prefix[s]) * inv[s] + (e - s).astype(U)
            at = to
    return Words(mix(out), start, end, np.searchsorted(start, offsets, side="left"), t)


def grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n words from each position, and the range of each document's.

    A document of fewer than n words has none.
    """
    return span_hash(w.hash, n), np.minimum(w.first[:-1], w.first[1:]), np.maximum(w.first[1:] - n + 1, w.first[:-1])


def span_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of h[i:i+n] for each i, built by doubling; it runs over the ends of documents."""
    if len(h) < n:
        return np.zeros(0, U)
    with np.errstate(over="ignore"):
        acc, have, power, size, rest = None, 0, h, 1, n
        while rest:
            if rest & 1:
                acc = power[: len(power)] if acc is None else _join(acc, power, have, size)
                have += size
            rest >>= 1
            if rest:
                power = _join(power, power, size, size)
                size *= 2
        return mix(acc[: len(h) - n + 1] + U(n))


def _join(left: np.ndarray, right: np.ndarray, n_left: int, n_right: int) -> np.ndarray:
    m = min(len(left), len(right) - n_left)
    return left[:m] * U((pow(0xD6E8FEB86659FD93, n_right, 1 << 64))) + right[n_left : n_left + m]


def span_of(h: np.ndarray) -> int:
    """span_hash of a whole array."""
    return int(span_hash(h, len(h))[0]) if len(h) else 0


def text_chunks(batches: Iterator[pa.RecordBatch], text: str, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``size`` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = buffers(batch.column(text))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to
    give_back()


def give_back() -> None:
    """Return memory that allocators hold to the system: a worker that has done its part stays, with its peak, beside those of other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def winnow(g: np.ndarray, lo: np.ndarray, hi: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of w neighbouring grams, the place of its smallest hash (the last of equals).

    ``lo[i]:hi[i]`` are document i's grams. A document with fewer than w grams is
    one window. Returns the window starts and the chosen place of each.
    """
    n = hi - lo
    full = n >= w
    starts, picks = [], []
    if len(g) >= w and full.any():
        m = len(g) - w + 1
        # argmin by doubling: keep value and place, ties to the right
        val, pos, size = g.copy(), np.arange(len(g)), 1
        while size * 2 <= w:
            a, b = val[:-size], val[size:]
            right = b <= a
            pos = np.where(right, pos[size:], pos[:-size])
            val = np.where(right, b, a)
            size *= 2
        a, b = val[:m], val[w - size : w - size + m]
        pick = np.where(b <= a, pos[w - size : w - size + m], pos[:m])
        at = ranges(lo[full], hi[full] - w + 1)
        starts.append(at)
        picks.append(pick[at])
    short = np.flatnonzero((n > 0) & ~full)
    if len(short):
        at = ranges(lo[short], hi[short])
        cuts = np.concatenate([[0], np.cumsum(n[short])[:-1]])
        least = np.minimum.reduceat(g[at], cuts)
        owner = np.repeat(np.arange(len(short)), n[short])
        hit = np.flatnonzero(g[at] == least[owner])
        last = np.zeros(len(short), np.int64)
        last[owner[hit]] = at[hit]
        starts.append(lo[short])
        picks.append(last)
    if not starts:
        z = np.zeros(0, np.int64)
        return z, z
    return np.concatenate(starts), np.concatenate(picks)


def ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All whole numbers of lo[i]:hi[i], one range after the other."""
    n = np.maximum(hi - lo, 0)
    total = int(n.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.arange(total) + np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
