"""Words and word n-grams of Arrow string columns, as numpy arrays over UTF-8 bytes.

All functions work on slices of whole rows: a slice ends at a row end, so a text
is never cut.  Hashes are 64 bits of a polynomial over the bytes, mixed.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
SMALL_BYTES = 1 << 17
"""A slice whose hashes, 8 bytes a byte and several at a time, stay in the processor's cache."""
BLOCK_BYTES = 1 << 21

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_MASK = (1 << 64) - 1
_M = np.uint64(0xD6E8FEB86659FD93)


def _table(is_word) -> np.ndarray:
    return np.array([bool(is_word(b)) for b in range(256)])


#: words `[^\x20\x09-\x0D]+`
SPACED = _table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of lower-cased text
ALNUM = _table(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)

_POWERS: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; read only.  The first SLICE_BYTES + 1 (4 MB) are kept."""
    kept = _POWERS.get(base)
    if kept is not None and n <= len(kept):
        return kept[:n]
    size = min(1 << max(n - 1, 1).bit_length(), SLICE_BYTES) + 1
    p = np.full(max(n, size), base, dtype=np.uint64)
    p[:1] = 1
    with np.errstate(over="ignore"):
        np.multiply.accumulate(p, out=p)
    p.flags.writeable = False
    if n <= size:
        _POWERS[base] = p
    return p[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every input bit over the 64 output bits."""
    h = h.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        h ^= h >> np.uint64(32)
        h *= _M
        h ^= h >> np.uint64(32)
        h *= _M
        h ^= h >> np.uint64(32)
    return h


def slices(column: pa.Array, size: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets into bytes) of at most ``size`` bytes or one row; null counts as empty."""
    size = size or SLICE_BYTES
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + size, side="right")) - 1)
        b = min(b, n)
        yield a, b, raw[offs[a]:offs[b]], offs[a:b + 1] - offs[a]
        a = b


def _running(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At every place of ``at`` (ascending): the sum of (byte + 1) * base ** position before it, and base ** -place.

    The bytes are worked on in blocks: no array of 8 bytes per byte of a very long text.
    """
    size = min(BLOCK_BYTES, len(data) + 1)
    up, down = _power(_BASE, size), _power(_INVERSE, size)
    total, undo = np.empty(len(at), np.uint64), np.empty(len(at), np.uint64)
    before, far, back = np.uint64(0), np.uint64(1), np.uint64(1)  # of the block's first byte
    for a in range(0, len(data) + 1, size):
        v = data[a:a + size].astype(np.uint64)
        v += np.uint64(1)
        v *= up[:len(v)]
        c = np.zeros(len(v) + 1, dtype=np.uint64)
        np.cumsum(v, out=c[1:])
        c *= far
        c += before
        lo, hi = np.searchsorted(at, (a, a + size))
        total[lo:hi] = c[at[lo:hi] - a]
        undo[lo:hi] = down[at[lo:hi] - a] * back
        before, far, back = c[-1], far * up[-1] * np.uint64(_BASE & _MASK), back * down[-1] * np.uint64(_INVERSE)
    return total, undo


def byte_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges [start, end); ascending starts and ascending ends."""
    with np.errstate(over="ignore"):
        if len(data) <= BLOCK_BYTES:
            v = data.astype(np.uint64)
            v += np.uint64(1)
            v *= _power(_BASE, len(v))
            c = np.zeros(len(v) + 1, dtype=np.uint64)
            np.cumsum(v, out=c[1:])
            h = c[end] - c[start]
            h *= _power(_INVERSE, len(v) + 1)[start]
        else:
            before, undo = _running(data, start)
            h = _running(data, end)[0] - before
            h *= undo
        h += (end - start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    return mix(h)


@dataclass
class Words:
    """Words of a slice: byte ranges, hashes, and word ranges per row."""
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray   # per row: index of its first word
    count: np.ndarray   # per row: number of words
    row: np.ndarray     # per word: its row in the slice


def words(data: np.ndarray, offs: np.ndarray, kind: np.ndarray, fold: np.ndarray = SAME,
          hashed: bool = True) -> Words:
    w = kind[data]
    s = w.copy()
    e = w.copy()
    if len(w):
        s[1:] &= ~w[:-1]
        e[:-1] &= ~w[1:]
        cuts = offs[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(w))]
        s[cuts] = w[cuts]
        e[cuts - 1] = w[cuts - 1]
    start = np.flatnonzero(s)
    end = np.flatnonzero(e) + 1
    bounds = np.searchsorted(start, offs)
    count = np.diff(bounds)
    h = byte_hashes(data if fold is SAME else fold[data], start, end) if hashed else np.zeros(0, np.uint64)
    return Words(start, end, h, bounds[:-1], count, np.repeat(np.arange(len(count)), count))


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of n consecutive word hashes starting at every word (the last n-1 are dropped)."""
    if len(h) < n:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        g = h[:len(h) - n + 1].copy()
        for k in range(1, n):
            g *= np.uint64(0x9FB21C651E98DF25)
            g += h[k:len(h) - n + 1 + k]
    return mix(g)


def inside(w: Words, n: int) -> np.ndarray:
    """Word indices at which an n-gram lies within its row."""
    last = np.repeat(w.first + w.count, w.count) - n
    at = np.arange(len(w.row))
    return np.flatnonzero(at <= last)
