"""Texts as numpy arrays: words, hashes of spans and n-grams, and anchors of windows, over whole Arrow batches at once."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes of text that are worked on at once; one longer document is worked on alone.
SLICE_BYTES = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Odd multipliers of the polynomial hashes.
BYTE_BASE, GRAM_BASE, GRAM_BASE_2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i in 0..n."""
    have = _powers.get(base)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, 1 << 16)
        inverse = pow(base, -1, 1 << 64)
        both = []
        for b in (base, inverse):
            x = np.full(size, b, U)
            x[0] = 1
            both.append(np.cumprod(x, dtype=U))
        have = (both[0], both[1])
        if size <= 4 << 20:
            _powers[base] = have
    return have


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(30))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def texts(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of a text column as (first row, row after the last, bytes, offsets); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    a = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(a):
        return
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(a):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in bytes, and each document's first word (one entry more than documents)."""
    ok = ~SPACE[data]
    start, end = ok.copy(), ok.copy()
    start[1:] &= ~ok[:-1]
    end[:-1] &= ~ok[1:]
    inner = off[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    start[inner] |= ok[inner]
    end[inner - 1] |= ok[inner - 1]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1, np.searchsorted(s, off)


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span."""
    return Prefix(data, BYTE_BASE).spans(start, end)


def gram_hash(h: np.ndarray, k: int, base: int = GRAM_BASE) -> np.ndarray:
    """64-bit hash of each k consecutive entries of h."""
    return Prefix(h, base).grams(k)


class Prefix:
    """Sums from which the hash of any span of units follows at once."""

    def __init__(self, units: np.ndarray, base: int):
        p, self.q = powers(base, len(units))
        self.c = np.zeros(len(units) + 1, U)
        np.cumsum((units.astype(U) + U(1)) * p[: len(units)], out=self.c[1:])

    def grams(self, k: int) -> np.ndarray:
        n = len(self.c) - k
        return mix((self.c[k:] - self.c[:n]) * self.q[:n]) if n > 0 else np.zeros(0, U)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.c[end] - self.c[start]) * self.q[start] + (end - start).astype(U))


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    have = 1
    out = a
    while have * 2 <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(a) - w + 1], out[w - have :]) if have < w else out


def owners(off: np.ndarray) -> np.ndarray:
    """The document of each unit."""
    return np.repeat(np.arange(len(off) - 1), np.diff(off))


def anchors(grams: np.ndarray, off: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor of every window of `window` units inside one document: its leftmost k-gram of least hash.

    Equal windows have equal anchors, so whatever recurs can be sought among anchors alone.
    Returns for each anchor its position and the first and last start of the windows that chose it.
    """
    n, none = int(off[-1]), np.zeros(0, np.int64)
    if n < window:
        return none, none, none
    bits = max(1, int(n).bit_length())
    mask = U((1 << bits) - 1)
    key = (grams & ~mask) | np.arange(len(grams), dtype=U)
    least = sliding_min(key, window - k + 1)
    room = np.repeat(off[1:], np.diff(off))[: len(least)]
    starts = np.flatnonzero(np.arange(len(least)) + window <= room)
    if not len(starts):
        return none, none, none
    pos = (least[starts] & mask).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], pos[1:] != pos[:-1]]))
    last = np.concatenate([new[1:], [len(pos)]]) - 1
    return pos[new], starts[new], starts[last]


def ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """first[0]..last[0], first[1]..last[1], ... in one array."""
    n = last - first + 1
    if not len(n):
        return np.zeros(0, np.int64)
    out = np.ones(int(n.sum()), np.int64)
    ends = np.cumsum(n)
    out[0] = first[0]
    out[ends[:-1]] = first[1:] - last[:-1]
    return np.cumsum(out)


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n units lie in start..start+length-1 of any start."""
    d = np.bincount(starts, minlength=n + 1) - np.bincount(starts + length, minlength=n + 1)
    return np.cumsum(d[:n]) > 0


def member(x: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    """Whether each x is in a sorted array."""
    if not len(sorted_set):
        return np.zeros(len(x), bool)
    i = np.minimum(np.searchsorted(sorted_set, x), len(sorted_set) - 1)
    return sorted_set[i] == x


class Pairs:
    """A set of 128-bit keys, each as two 64-bit halves, with room for a value's row number."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.order = np.lexsort((b, a))
        self.a, self.b = a[self.order], b[self.order]
        self.longest = int(np.diff(np.flatnonzero(np.concatenate([[True], self.a[1:] != self.a[:-1], [True]]))).max()) if len(a) else 0

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Row number in the arrays given, or -1."""
        out = np.full(len(a), -1, np.int64)
        if not len(self.a) or not len(a):
            return out
        i = np.searchsorted(self.a, a)
        for step in range(self.longest):
            j = np.minimum(i + step, len(self.a) - 1)
            hit = (self.a[j] == a) & (self.b[j] == b)
            out[hit] = self.order[j[hit]]
        return out


def trim() -> None:
    """Gives freed memory back to the system: an idle Python worker would keep it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def as_u64(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64, copy=False).view(U)
