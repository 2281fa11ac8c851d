"""Bloom filters built by Spark, and rolling hashes of word n-grams in numpy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

U64 = np.uint64
_STEP = U64(0x9E3779B97F4A7C15)
_BACK = U64(pow(int(_STEP), -1, 1 << 64))


class Bloom:
    """A Bloom filter over 64-bit hashes with ``1 << log_bits`` bits. Its size
    is fixed, 2 MB by default: with more keys it lets more through, and never
    drops one that was put in."""

    def __init__(self, words: np.ndarray, log_bits: int, probes: int) -> None:
        self.words, self.log_bits, self.probes = words, log_bits, probes

    @classmethod
    def of(cls, hashes: DataFrame, column: str, log_bits: int = 24, probes: int = 4) -> Bloom:
        """The filter of a column of hashes. The bits are set by tasks and or-ed
        by Spark; what comes to the driver is the filter, never the hashes."""
        mask = F.lit((1 << log_bits) - 1).cast("long")
        h = F.col(column)
        first, step = h.bitwiseAND(mask), F.shiftrightunsigned(h, 32).bitwiseAND(mask).bitwiseOR(F.lit(1).cast("long"))
        bits = hashes.where(h.isNotNull()).select(F.explode(F.array(*[(first + step * i).bitwiseAND(mask) for i in range(probes)])).alias("b"))
        word = bits.select(F.shiftright("b", 6).alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("b").bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
        words = np.zeros(1 << max(0, log_bits - 6), np.int64)
        for at, bit in word.groupBy("at").agg(F.bit_or("bit").alias("bits")).collect():
            words[at] = bit
        return cls(words.view(U64), log_bits, probes)

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        h = hashes.astype(np.int64, copy=False).view(U64)
        mask = U64((1 << self.log_bits) - 1)
        first, step = h & mask, ((h >> U64(32)) & mask) | U64(1)
        out = np.ones(len(h), bool)
        for i in range(self.probes):
            b = (first + step * U64(i)) & mask
            out &= (self.words[b >> U64(6)] >> (b & U64(63))) & U64(1) == 1
        return out

    def column(self, hashes: Column) -> Column:
        """``may_hold`` over a column, in Arrow batches."""
        @F.pandas_udf(T.BooleanType())
        def may(h: pd.Series) -> pd.Series:
            return pd.Series(self.may_hold(h.to_numpy()))

        return may(hashes)


@lru_cache(maxsize=1)
def _codes() -> np.ndarray:
    return np.random.default_rng(77).integers(0, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = _POWERS.get(int(base))
    if p is None or len(p) < n:
        p = np.full(max(n, 1 << 16), base, U64)
        p[0] = 1
        p = np.cumprod(p)
        if n <= 1 << 21:  # what a task keeps
            _POWERS[int(base)] = p
    return p[:n]


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans ``raw[start:end]``, from one pass of
    prefix sums: the same for equal bytes wherever they stand."""
    prefix = np.zeros(len(raw) + 1, U64)
    np.cumsum(_codes()[raw] * _powers(_STEP, len(raw)), out=prefix[1:])
    h = (prefix[ends] - prefix[starts]) * _powers(_BACK, len(raw) + 1)[starts] + (ends - starts).astype(U64) * U64(0xC2B2AE3D27D4EB4F)
    h = (h ^ (h >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return (h ^ (h >> U64(32))).view(np.int64)


def word_gram_spans(raw: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all runs of ``n`` words, words being what single
    spaces part."""
    blank = np.flatnonzero(raw == 32)
    starts, ends = np.concatenate([[0], blank + 1]), np.concatenate([blank, [len(raw)]])
    k = max(0, len(starts) - n + 1)
    return starts[:k], ends[len(ends) - k:]
