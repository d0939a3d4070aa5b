"""Gear rolling hash and the cuts that it gives."""

from __future__ import annotations

import numpy as np

WINDOW = 32  # bytes that a hash value depends on


def _table() -> np.ndarray:
    """One 32-bit number for each byte, from the splitmix64 sequence that starts at 0."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return (x ^ x >> np.uint64(31)).astype(np.uint32)


TABLE = _table()


def hashes(data: np.ndarray) -> np.ndarray:
    """At each byte, the gear hash ``h = (h << 1) + TABLE[byte]`` in 32 bits, which forgets bytes older than WINDOW.

    The sum over the window is built by doubling: of the sums over 1, 2, 4, 8 and 16 bytes, two make the next.
    """
    h = TABLE[data]
    for k in (1, 2, 4, 8, 16):
        if len(h) > k:
            older = h[:-k] << np.uint32(k)
            h = h.copy() if k == 1 else h
            h[k:] += older
    return h


def masked_cuts(data: np.ndarray, least: int, mean_bits: int, most: int) -> list[int]:
    """Ends of chunks: after a byte whose hash has its top mean_bits zero, with least to most bytes in a chunk."""
    n = len(data)
    ends: list[int] = []
    candidates = np.flatnonzero(hashes(data) >> np.uint32(32 - mean_bits) == 0) + 1
    start = 0
    while n - start > least:
        i = np.searchsorted(candidates, start + least)
        end = min(int(candidates[i]) if i < len(candidates) else n, start + most, n)
        ends.append(end)
        start = end
    if start < n:
        ends.append(n)
    return ends


def lowest_cuts(data: np.ndarray, reach: int) -> np.ndarray:
    """Places whose hash is below all others within ``reach`` bytes on both sides (the first of equal ones to the left).

    A cut depends on ``reach + WINDOW - 1`` bytes before and ``reach`` bytes after it and on nothing else, so equal
    passages are cut equally wherever they stand, but for their margins.
    """
    n = len(data)
    if n <= 2 * reach:
        return np.zeros(0, np.int64)
    h = hashes(data).astype(np.uint64) << np.uint64(32) | np.arange(n, dtype=np.uint64)
    low, span = h, 1
    while span * 2 <= 2 * reach + 1:  # minima over windows of doubling length
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    rest = 2 * reach + 1 - span
    if rest:
        low = np.minimum(low[: len(low) - rest], low[rest:])
    return np.flatnonzero(low == h[reach : n - reach]) + reach
