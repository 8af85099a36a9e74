"""Bloom filter over a column of hashes: bits are set and merged in aggregations, so only the finished
filter reaches the driver, and it has at most MAX_BITS bits (16 MB) whatever the number of keys."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

MAX_BITS = 1 << 27
BITS_PER_KEY = 12
PROBES = 4
#: Beyond so many keys the largest filter would let more than half of all foreign keys through; then there is none.
MAX_KEYS = MAX_BITS // 3


def build(keys: DataFrame, hash_col: str, n_keys: int) -> np.ndarray | None:
    """The filter's words (uint64) for a column of 64-bit hashes; None if there are too many keys to be worth it."""
    if n_keys > MAX_KEYS:
        return None
    bits = min(MAX_BITS, max(1 << 16, 1 << (n_keys * BITS_PER_KEY).bit_length()))
    low, high = F.expr(f"{hash_col} & 4294967295L"), F.expr(f"shiftrightunsigned({hash_col}, 32)")
    at = F.explode(F.array(*[F.expr("0L") + F.pmod(low + high * i, F.lit(bits)) for i in range(PROBES)]))
    words = keys.select(at.alias("at")).groupBy(F.expr("at div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("set"))
    rows = words.toPandas()
    out = np.zeros(bits // 64, np.uint64)
    out[rows["word"].to_numpy(np.int64)] = rows["set"].to_numpy(np.int64).view(np.uint64)
    return out


def might_contain(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each uint64 hash may be among the keys; False is certain."""
    bits = np.uint64(len(words) * 64)
    low, high = hashes & np.uint64(0xFFFFFFFF), hashes >> np.uint64(32)
    out = np.ones(len(hashes), bool)
    for i in range(PROBES):
        at = (low + high * np.uint64(i)) % bits
        out &= (words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
    return out
