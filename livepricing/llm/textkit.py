"""Vectorised words, hashes and fingerprints over Arrow text columns.

Texts are handled as the contiguous UTF-8 bytes of an Arrow string column, a slice of about
``SLICE_BYTES`` at a time (a longer text is a slice of its own), so the memory of a task
follows the longest text and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

#: White space that separates words: blank and 0x09-0x0D.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective), so that sums and products of hashes look random."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_POW = np.ones(1, np.uint64)
_IPOW = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i below n; kept between calls, grown when needed."""
    global _POW, _IPOW
    if len(_POW) < n:
        size = max(n, SLICE_BYTES + (SLICE_BYTES >> 1))
        for name, b in (("_POW", _BASE), ("_IPOW", _INV)):
            a = np.full(size, b, np.uint64)
            a[0] = 1
            globals()[name] = np.multiply.accumulate(a)
    return _POW, _IPOW


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """S with S[i] = sum of byte hashes times base powers before i; a substring hash is
    ``(S[e] - S[s]) * base^-s``."""
    pw, _ = powers(len(data) + 1)
    s = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * pw[: len(data)], out=s[1:])
    return s


def span_hash(s: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, ip = powers(len(s))
    return mix((s[ends] - s[starts]) * ip[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def text_slices(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets into them) of a string column; a null
    text has no bytes."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type)
    _, off, data = col.buffers()
    n = len(col)
    if not n:
        return
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset: col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j, raw[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts of a slice, and the index of each text's
    first word (one more entry than texts). Words never cross texts."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1: n + 1] = ~SPACE[data]
    edge = np.zeros(n + 1, bool)  # a text begins here
    edge[offsets] = True
    first = inside[1:] & (~inside[:-1] | edge)
    last = inside[:-1] & (~inside[1:] | edge)
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    return starts, ends, np.searchsorted(starts, offsets)


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
