"""A Bloom filter over 64-bit hashes, filled by an aggregation and tested in NumPy.

Its size follows the number of keys up to MOST_BITS (32 MB), which bounds what is sent to the driver
and the tasks; beyond that more strangers pass, which costs time and never a row, since what passes is
always joined exactly.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits for each key: with two bits set, one stranger in sixty passes.
BITS_PER_KEY, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 28


def size_for(keys: int) -> int:
    """Bits of the filter of so many keys: a power of two."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_PER_KEY * max(keys, 1) - 1).bit_length()))


def _slots(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(bits - 1)
    return h & mask, (h >> np.uint64(35)) & mask


def passes(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the hashes (uint64) may be among the keys."""
    out = np.zeros(len(h), bool)
    bits = len(words) * 64
    first, second = _slots(h, bits)
    at = np.flatnonzero((words[(first >> np.uint64(6)).astype(np.int64)] >> (first & np.uint64(63))) & np.uint64(1))
    s = second[at]
    out[at] = (words[(s >> np.uint64(6)).astype(np.int64)] >> (s & np.uint64(63))) & np.uint64(1) == 1
    return out


def of_keys(h: np.ndarray) -> np.ndarray:
    words = np.zeros(size_for(len(h)) // 64, np.uint64)
    for s in _slots(h, len(words) * 64):
        np.bitwise_or.at(words, (s >> np.uint64(6)).astype(np.int64), np.uint64(1) << (s & np.uint64(63)))
    return words


def of_column(keys: DataFrame, column: str, n: int) -> np.ndarray:
    """The filter of a column of hashes (long), of which there are about ``n``."""
    bits = size_for(n)
    mask = F.lit(bits - 1).cast("long")
    h = F.col(column)
    slots = F.explode(F.array(h.bitwiseAND(mask), F.call_function("shiftrightunsigned", h, F.lit(35)).bitwiseAND(mask)))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("s") % 64).cast("int"))
    rows = (
        keys.select(slots.alias("s"))
        .groupBy(F.floor(F.col("s") / 64).cast("long").alias("word"))
        .agg(F.bit_or(one).alias("bits"))
        .toPandas()  # at most MOST_BITS / 64 rows
    )
    words = np.zeros(bits // 64, np.uint64)
    words[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return words
