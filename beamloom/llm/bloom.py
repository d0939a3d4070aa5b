"""Bloom filters: built by a Spark aggregation, sized by the number of keys, tested in numpy on the executors.

A filter never misses a key; its false alarms only let more rows through. It has 16 bits for each key, up to ``MOST_BITS``
(16 MB), whatever the number of keys, so it can be broadcast; beyond that it lets more rows through and changes no result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_BITS, HASHES = 1 << 27, 3
_SHIFT = 18


def build(keys: DataFrame, hashed: Column) -> np.ndarray:
    """Filter of the 64-bit hashes of ``keys``, as words of 64 bits; a row for each word that isn't 0 comes to the driver."""
    size = min(MOST_BITS, 1 << max(10, (16 * keys.count()).bit_length()))
    places = F.transform(F.array(*[F.lit(_SHIFT * i) for i in range(HASHES)]), lambda s: F.pmod(F.call_function("shiftrightunsigned", hashed, s), F.lit(size)))
    words = keys.select(F.explode(places).alias("p")).groupBy(F.floor(F.col("p") / 64).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits"))
    got = words.toArrow()  # 16 bytes a row; without Arrow's setting, toPandas would make an object of each
    bits = np.zeros(size // 64, np.uint64)
    bits[got["w"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return bits


def hits(bits: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """Which of the hashes (uint64) may be in the filter."""
    found, size = np.ones(len(hashed), bool), np.uint64(64 * len(bits))
    for i in range(HASHES):
        p = (hashed >> np.uint64(_SHIFT * i)) % size
        found &= (bits[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
    return found
