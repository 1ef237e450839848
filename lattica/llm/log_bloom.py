"""Log-frequency Bloom filter: quantised counts kept as repeated memberships.

An item of count ``c`` is inserted with each level ``1 .. 1 + floor(log2 c)``.
Its count is read by probing levels from 1 on until one is missing; a false
membership can only raise the answer, and rarely by more than one level.

The filter is made in slices, one for each bucket of items, so that slices are
built where their items are counted. A slice takes ``BITS`` bits for each entry
and holds every item, unless a caller bounds its size: then items below the
least sufficient count are left out (the slice keeps that count).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .textblocks import U64, mix64

BITS, HASHES = 12, 6


def levels(count: np.ndarray) -> np.ndarray:
    """Number of levels of each count (0 for 0)."""
    return np.frexp(count.astype(np.float64))[1].astype(np.int64)


def middle(level: np.ndarray) -> np.ndarray:
    """The count that a number of levels stands for: the geometric middle of its range."""
    low = np.ldexp(1.0, np.maximum(level, 1) - 1)
    return np.where(level > 0, np.sqrt(low * np.maximum(low, 2 * low - 1)), 0.0)


def _places(items: np.ndarray, level: int, j: int, bits: np.ndarray) -> np.ndarray:
    return mix64(items + U64((level * 0x9FB21C651E98DF25 + j * 0xC2B2AE3D27D4EB4F) % (1 << 64))) % bits


@dataclass
class Slice:
    data: np.ndarray
    least: int


def build(items: np.ndarray, counts: np.ndarray, most_bytes: int | None = None) -> Slice:
    """A slice of all items, or one of at most ``most_bytes``."""
    level = levels(counts)
    least = 1
    while most_bytes is not None and int(level[counts >= least].sum()) * BITS > 8 * most_bytes:
        least += 1
    items, level = items[counts >= least], level[counts >= least]
    size = max(1, -(-int(level.sum()) * BITS // 8))
    data, bits = np.zeros(size, np.uint8), U64(8 * size)
    for q in range(1, int(level.max(initial=0)) + 1):
        own = items[level >= q]
        for j in range(HASHES):
            at = _places(own, q, j, bits)
            np.bitwise_or.at(data, (at >> U64(3)).astype(np.int64), np.left_shift(1, (at & U64(7)).astype(np.uint8), dtype=np.uint8))
    return Slice(data, least)


class Filter:
    """All slices; items are looked up in the slice of their bucket."""

    def __init__(self, slices: list[Slice]):
        self.data = np.concatenate([s.data for s in slices])
        sizes = np.array([len(s.data) for s in slices], np.int64)
        self.first = (np.cumsum(sizes) - sizes).astype(U64) * U64(8)
        self.bits = sizes.astype(U64) * U64(8)
        self.least = [s.least for s in slices]

    def levels(self, items: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Levels found for each item."""
        out = np.zeros(len(items), np.int64)
        live, q = np.arange(len(items)), 1
        while len(live):
            for j in range(HASHES):
                own = bucket[live]
                at = _places(items[live], q, j, self.bits[own]) + self.first[own]
                live = live[(self.data[(at >> U64(3)).astype(np.int64)] >> (at & U64(7)).astype(np.uint8)) & 1 == 1]
            out[live] = q
            q += 1
        return out
