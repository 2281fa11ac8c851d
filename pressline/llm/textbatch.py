"""Vectorised word handling over a chunk of UTF-8 texts laid end to end.

``buf`` holds the bytes of all texts of the chunk, ``off`` their offsets
(texts + 1). A word is a run of bytes other than space and 0x09-0x0D.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U64 = np.uint64
WS = np.zeros(256, bool)
WS[[0x20, *range(0x09, 0x0E)]] = True
BASE = U64(0x9E3779B97F4A7C15 | 1)
INVERSE = U64(pow(int(BASE), -1, 1 << 64))


@lru_cache(maxsize=4)
def byte_codes(lower: bool) -> np.ndarray:
    """A random 64-bit code per byte; with ``lower`` A-Z have those of a-z."""
    t = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
    if lower:
        t[65:91] = t[97:123]
    return t


_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, kept per worker and grown on demand."""
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        p = np.full(max(n, 1 << 16), base, U64)
        p[0] = 1
        have = np.cumprod(p)
        if n <= 2 << 20:
            _POWERS[int(base)] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit over all 64."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(33))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


def rolling(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values * BASE^i: the state of a rolling hash."""
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * powers(BASE, len(values)), out=out[1:])
    return out


def window(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end], the same wherever the run stands."""
    h = (prefix[end] - prefix[start]) * powers(INVERSE, len(prefix))[start]
    return mix(h + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the first word's number per text (texts + 1)."""
    n = len(buf)
    inside = ~WS[buf]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    s, e = inside.copy(), inside.copy()
    s[1:] &= ~inside[:-1] | edge[1:n]
    e[:-1] &= ~inside[1:] | edge[1:n]
    starts = np.flatnonzero(s)
    return starts, np.flatnonzero(e) + 1, np.searchsorted(starts, off)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    return window(rolling(byte_codes(lower)[buf]), starts, ends)


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:first[i + 1]], empty ranges included."""
    c = np.zeros(len(values) + 1, np.int64 if values.dtype.kind in "biu" else np.float64)
    np.cumsum(values, out=c[1:])
    return c[first[1:]] - c[first[:-1]]
