"""Elias-Fano coding of non-decreasing integers, with sampled select.

``n`` values below ``u`` take about ``n * (2 + log2(u / n))`` bits: the low bits
of each value lie packed, the high parts are written in unary in a bit vector.
``select`` finds the i-th set bit from a sample of every ``SAMPLE``-th position
and byte counts, so no table of 64-bit offsets is kept.
"""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 512
_HEAD = struct.Struct("<QQBI")
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    if not width or not len(values):
        return np.empty(0, np.uint8)
    bits = (values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")


def encode(values: np.ndarray) -> bytes:
    """``values``: non-decreasing and not negative."""
    v = np.asarray(values, np.uint64)
    n = len(v)
    u = int(v[-1]) + 1 if n else 1
    width = max(0, (u // max(n, 1)).bit_length() - 1)
    low = np.concatenate([_pack(v[i : i + 65536] & np.uint64((1 << width) - 1), width) for i in range(0, n, 65536)] or [np.empty(0, np.uint8)])
    at = (v >> np.uint64(width)).astype(np.int64) + np.arange(n)
    upper = np.zeros((int(at[-1]) if n else 0) // 8 + 1, np.uint8)
    np.bitwise_or.at(upper, at >> 3, (1 << (at & 7)).astype(np.uint8))
    samples = at[::SAMPLE].astype("<u4")
    return _HEAD.pack(n, u, width, len(upper)) + samples.tobytes() + low.tobytes() + upper.tobytes()


class Reader:
    """Random access to an encoded sequence; ``size`` is the number of bytes it takes."""

    def __init__(self, data: bytes, at: int = 0):
        self.n, self.u, self.width, upper = _HEAD.unpack_from(data, at)
        k, low = -(-self.n // SAMPLE), 0
        for i in range(0, self.n, 65536):
            low += -(-min(65536, self.n - i) * self.width // 8)
        p = at + _HEAD.size
        self.samples = np.frombuffer(data, "<u4", k, p)
        self.low = np.frombuffer(data, np.uint8, low, p + 4 * k)
        self.upper = np.frombuffer(data, np.uint8, upper, p + 4 * k + low)
        self.size = _HEAD.size + 4 * k + low + upper

    def select(self, i: int) -> int:
        """Position of the i-th set bit of the upper bits (from 0)."""
        at = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        byte, bit = at >> 3, at & 7
        left += int(_ONES[self.upper[byte] & ((1 << bit) - 1)])
        while True:  # a sample's span has SAMPLE set bits, a few hundred bytes as a rule
            block = _ONES[self.upper[byte : byte + 256]].cumsum()
            if left < block[-1]:
                k = int(np.searchsorted(block, left, "right"))
                left -= int(block[k - 1]) if k else 0
                ones = np.flatnonzero(np.unpackbits(self.upper[byte + k : byte + k + 1], bitorder="little"))
                return 8 * (byte + k) + int(ones[left])
            left -= int(block[-1])
            byte += 256

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        part, within = divmod(i, 65536)
        first = part * (65536 * self.width // 8) * 8 + within * self.width
        low = 0
        if self.width:
            a = first >> 3
            low = int.from_bytes(self.low[a : a + 9].tobytes(), "little") >> (first & 7) & ((1 << self.width) - 1)
        return (self.select(i) - i) << self.width | low

    def all(self) -> np.ndarray:
        """The whole sequence."""
        ones = np.flatnonzero(np.unpackbits(self.upper, bitorder="little"))[: self.n]
        out = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.width)
        if self.width:
            step = 65536 * self.width // 8
            for k, i in enumerate(range(0, self.n, 65536)):
                m = min(65536, self.n - i)
                bits = np.unpackbits(self.low[k * step : k * step + -(-m * self.width // 8)], bitorder="little")[: m * self.width]
                out[i : i + m] |= (bits.reshape(m, self.width).astype(np.uint64) << np.arange(self.width, dtype=np.uint64)).sum(1, dtype=np.uint64)
        return out.astype(np.int64)
