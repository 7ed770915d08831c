"""Vectorised views of text batches for the corpus operators.

All helpers work on the UTF-8 bytes of a slice of documents laid end to end:
``buf`` (uint8) and ``off`` (int64, one more entry than documents). A word is
a maximal run of bytes outside space and 0x09-0x0D, which on UTF-8 is the
same as ``[^\\x20\\x09-\\x0D]+`` on code points. Hashes are 64-bit.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


@lru_cache(maxsize=2)
def _powers(n: int, base: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64 (kept for the usual slice size)."""
    if n <= SLICE_BYTES + 1:
        return _powers(SLICE_BYTES + 1, base)[:n]
    p = np.full(n, base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def slices(column, limit: int = SLICE_BYTES):
    """Yields (first row, last row + 1, buf, off) over an Arrow string column,
    about ``limit`` bytes at a time, always at least one whole document. A
    null text is empty."""
    col = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    col = pc.fill_null(col.cast(pa.large_string()), "")
    n = len(col)
    if not n:
        return
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + n + 1]
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j, raw[off[i]:off[j]], off[i:j + 1] - off[i]
        i = j


def lower(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def words(buf: np.ndarray, off: np.ndarray):
    """(start, end, document index) of every word of the slice."""
    inside = ~_SPACE[buf]
    n = len(buf)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(off, start, "right") - 1


def span_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span: equal bytes give equal hashes wherever
    they stand."""
    n = len(buf)
    acc = np.zeros(n + 1, np.uint64)
    if n:
        np.cumsum(_BYTE[buf] * powers(n, _BASE), out=acc[1:])
    inv = powers(n + 1, _BASE_INV)
    return mix((acc[end] - acc[start]) * inv[start] + (end - start).astype(np.uint64))


def shingles(h: np.ndarray, doc: np.ndarray, n_docs: int, k: int):
    """(hash, document) of every k-word shingle; a document with 1 to k - 1
    words has its whole word sequence as its one shingle."""
    count = np.bincount(doc, minlength=n_docs)
    first = np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64)
    mult = mix(np.arange(1, k + 1, dtype=np.uint64)) | _U(1)
    if len(h) >= k:
        here = np.flatnonzero(doc[:len(h) - k + 1] == doc[k - 1:])
    else:
        here = np.zeros(0, np.int64)
    acc = np.full(len(here), k, np.uint64)
    for j in range(k):
        acc += h[here + j] * mult[j]
    out, owner = mix(acc), doc[here]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            has = count[short] > j
            extra[has] += h[first[short[has]] + j] * mult[j]
        extra = mix(extra + count[short].astype(np.uint64) + _U(1 << 32))
        out, owner = np.concatenate([out, extra]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        out, owner = out[order], owner[order]
    return out, owner


def bounds(owner: np.ndarray, n_docs: int) -> np.ndarray:
    """off-style bounds of each document's entries in an owner-sorted array."""
    return np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n_docs))]).astype(np.int64)
