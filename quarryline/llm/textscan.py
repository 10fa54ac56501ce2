"""Byte-level text scanning in numpy, shared by the text operators.

A *slab* is a bounded run of whole texts: one ``uint8`` array with the UTF-8
bytes and an ``int64`` offset array, taken from an Arrow string column without
making Python strings.  Words are maximal runs of bytes outside
``\\x20 \\x09-\\x0D``; as those are single bytes in UTF-8, byte scanning finds
exactly the words of ``[^\\x20\\x09-\\x0D]+``.  A null text is an empty text.

Hashes are 64-bit polynomial prefix hashes over a random byte table, finished
by an avalanche, so any number of spans is hashed from one cumulative sum.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLAB_BYTES = 1 << 20
U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser, element-wise."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_BASE = 0x9E3779B97F4A7C13  # odd, 3 mod 8
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, up to n; kept for the usual slab size only."""
    if len(_powers[0]) <= n:
        size = max(n, SLAB_BYTES) + 1
        made = []
        for b in (_BASE, _INVERSE):
            p = np.full(size, b, U)
            p[0] = 1
            made.append(np.cumprod(p))
        if size > 4 * SLAB_BYTES:
            return made[0], made[1]
        _powers[:] = made
    return _powers[0], _powers[1]


def slabs(column: pa.Array | pa.ChunkedArray, limit: int = SLAB_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of whole texts of about ``limit`` bytes; a longer text is a run of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string())
    if not len(column):
        return
    stops = _offsets(column)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(stops, stops[lo] + limit, "right")) - 1)
        hi = min(hi, len(column))
        part = column.slice(lo, hi - lo).fill_null("")  # run by run: the whole column is not copied
        offsets, raw = _offsets(part), part.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        yield lo, hi, data[offsets[0] : offsets[-1]], offsets - offsets[0]
        lo = hi
    release()


def _offsets(column: pa.LargeStringArray) -> np.ndarray:
    return np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)


def release() -> None:
    """Give freed memory back to the system: workers are kept for later stages, beside which others run."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def edges(inside: np.ndarray, offsets: np.ndarray, cut: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``inside``; runs also break at text starts and before the positions of ``cut``."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    fresh = np.zeros(n + 1, bool)
    fresh[offsets] = True
    if cut is not None:
        fresh[cut] = True
    out_before = np.ones(n, bool)
    out_before[1:] = ~inside[:-1] | fresh[1:-1]
    out_after = np.ones(n, bool)
    out_after[:-1] = ~inside[1:] | fresh[1:-1]
    return np.flatnonzero(inside & out_before), np.flatnonzero(inside & out_after) + 1


def owner(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Index of the text in which each start lies."""
    return np.searchsorted(offsets, starts, "right") - 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text index of every word."""
    starts, ends = edges(~SPACE[data], offsets)
    return starts, ends, owner(starts, offsets)


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text index of every \\n-split line, empty ones included (an empty text has none)."""
    breaks = np.flatnonzero(data == 10)
    full = np.diff(offsets) > 0
    starts = np.sort(np.concatenate([offsets[:-1][full], breaks + 1]))
    ends = np.sort(np.concatenate([offsets[1:][full], breaks]))
    doc = np.sort(np.concatenate([np.flatnonzero(full), owner(breaks, offsets)]))
    return starts, ends, doc


class Hasher:
    """Hashes of any spans of a slab."""

    def __init__(self, data: np.ndarray):
        self.up, self.down = _power(len(data))
        self.sums = np.zeros(len(data) + 1, U)
        np.cumsum(_BYTE[data] * self.up[: len(data)], out=self.sums[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(U))


def windows(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First items and hashes of all runs of n items within one text."""
    if len(h) < n:
        return np.zeros(0, np.int64), np.zeros(0, U)
    keys = mix(np.arange(1, n + 1, dtype=U) * U(0xD1342543DE82EF95)) | U(1)
    size = len(h) - n + 1
    total = h[:size] * keys[0]
    for j in range(1, n):
        total = total + h[j : j + size] * keys[j]
    first = np.flatnonzero(doc[:size] == doc[n - 1 :])
    return first, mix(total[first])


def repeated(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs more than once."""
    out = np.zeros(len(keys), bool)
    if len(keys) > 1:
        order = np.argsort(keys)
        s = keys[order]
        same = s[1:] == s[:-1]
        hit = np.zeros(len(keys), bool)
        hit[1:] = same
        hit[:-1] |= same
        out[order] = hit
    return out


def later(keys: np.ndarray) -> np.ndarray:
    """True where an equal key stands earlier."""
    out = np.zeros(len(keys), bool)
    if len(keys) > 1:
        order = np.argsort(keys, kind="stable")
        s = keys[order]
        hit = np.zeros(len(keys), bool)
        hit[1:] = s[1:] == s[:-1]
        out[order] = hit
    return out


def in_text(keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Keys made distinct by text."""
    return keys ^ mix((doc.astype(U) + U(1)) * U(0xA0761D6478BD642F))


def per_text(doc: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(doc, weights, minlength=n)


def code_points(data: np.ndarray) -> np.ndarray:
    """Running number of code points before each byte."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


#: Bytes of letters: ASCII letters and all bytes of longer characters.
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True


def letter_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text index of the maximal runs of letter bytes."""
    starts, ends = edges(LETTER[data], offsets)
    return starts, ends, owner(starts, offsets)


def ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def span_sums(running: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return running[ends] - running[starts]


def running(flags: np.ndarray) -> np.ndarray:
    """Cumulative sum with a leading zero."""
    out = np.zeros(len(flags) + 1, np.int64 if flags.dtype == bool else flags.dtype)
    np.cumsum(flags, out=out[1:])
    return out
