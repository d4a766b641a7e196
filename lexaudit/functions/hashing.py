"""Digests, hash buckets and the counter-based random numbers, as column expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

_WRAP = 1 << 32


def digest(text) -> Column:
    return F.sha2(col(text), 256)


def set_digest(ids) -> Column:
    """Aggregate: digest of the sorted ids, the same in any row order."""
    return F.sha2(F.array_join(F.array_sort(F.collect_list(col(ids))), ","), 256)


def hash_int(text, digits: int = 8) -> Column:
    """The first hex digits of the digest as a number."""
    return F.conv(F.substring(digest(text), 1, digits), 16, 10).cast("long")


def hash_fold(text, folds: int = 5) -> Column:
    return (hash_int(F.concat(F.lit("fold:"), col(text))) % folds).cast("int")


def hash_unit(text) -> Column:
    """A number from 0 to 1 that the text decides: the stand-in scorer."""
    return hash_int(text, 4) / F.lit(65535.0)


def sample_order(text, seed: int) -> Column:
    return digest(F.concat(F.lit(f"{seed}:"), col(text)))


def _times(a: Column, b: Column) -> Column:
    """Product of two 32-bit numbers mod 2**32, by halves of b so that nothing overflows."""
    low, high = b.bitwiseAND(0xFFFF), F.shiftrightunsigned(b, 16)
    return (a * low + (((a * high) % _WRAP) * 65536) % _WRAP) % _WRAP


def mulberry32(index, seed: int) -> Column:
    """The draw with this index of the 32-bit generator: its state is seed plus a multiple of a constant, so draws need no order."""
    step = 0x6D2B79F5
    s = (F.lit(seed).cast("long") + _times((col(index).cast("long") + 1) % _WRAP, F.lit(step).cast("long"))) % _WRAP
    t = _times(s.bitwiseXOR(F.shiftrightunsigned(s, 15)), s.bitwiseOR(F.lit(1).cast("long")))
    u = (t + _times(t.bitwiseXOR(F.shiftrightunsigned(t, 7)), t.bitwiseOR(F.lit(61).cast("long")))) % _WRAP
    t = t.bitwiseXOR(u)
    return t.bitwiseXOR(F.shiftrightunsigned(t, 14)) / F.lit(float(_WRAP))


def mulberry32_values(index: np.ndarray, seed: int) -> np.ndarray:
    """``mulberry32`` of an array of indices."""
    u = np.uint32
    s = ((index.astype(np.uint64) + np.uint64(1)) * np.uint64(0x6D2B79F5) + np.uint64(seed)).astype(u)
    t = (s ^ (s >> u(15))) * (s | u(1))
    t ^= t + (t ^ (t >> u(7))) * (t | u(61))
    return (t ^ (t >> u(14))) / float(_WRAP)


def sigmoid(x) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-35.0), F.least(F.lit(35.0), col(x)))))


def logit(p) -> Column:
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), col(p)))
    return F.ln(q / (1 - q))


def calibrate(raw, weight: float, intercept: float) -> Column:
    """Calibrated score; null without a raw score (greatest and least would pass over the null)."""
    return F.when(col(raw).isNotNull(), sigmoid(F.lit(intercept) + F.lit(weight) * logit(raw)))
