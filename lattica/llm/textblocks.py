"""Vectorised text primitives: many documents at a time, as byte arrays.

Documents are joined into one ``uint8`` buffer with a newline between them, and
words, shingles and windows are hashed for the whole buffer at once. All hashes
are 64 bit and depend on the bytes only, so they agree on every executor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every output bit depends on all input bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


#: A random 64-bit value for each byte, made by rule.
BYTE_CODES = mix64(np.arange(1, 257, dtype=U64) * U64(0xD1B54A32D192ED03))
#: Odd multipliers for the position of a word within a shingle.
PLACE_CODES = mix64(np.arange(1, 65, dtype=U64) * U64(0x8CB92BA72F3D8DD7)) | U64(1)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[65:91] += 32

_powers = np.empty(0, U64)
_inverses = np.empty(0, U64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base, and of its inverse modulo 2**64, up to ``n``."""
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 2 * CHUNK_BYTES)
        step = np.full(size, _BASE, U64)
        step[0] = 1
        _powers = np.cumprod(step, dtype=U64)
        step[1:] = U64(pow(_BASE, -1, 1 << 64))
        _inverses = np.cumprod(step, dtype=U64)
    return _powers[:n], _inverses[:n]


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``span_hash`` takes the hash of any span."""
    out = np.empty(len(buf) + 1, U64)
    out[0] = 0
    np.cumsum(BYTE_CODES[buf] * powers(len(buf))[0], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    inverse = powers(len(sums))[1]
    return mix64((sums[end] - sums[start]) * inverse[start] + (end - start).astype(U64))


def column_bytes(column: pa.Array) -> list[bytes]:
    """A string column as bytes; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    return column.cast(pa.binary() if not pa.types.is_large_string(column.type) else pa.large_binary()).to_pylist()


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One buffer of all texts with a newline after each; where each starts and ends."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes + 1) - 1
    return np.frombuffer(b"\n".join(texts) + b"\n", np.uint8), ends - sizes, ends


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts of at most ``limit`` bytes together (a longer text stands alone)."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > limit:
            yield first, texts[first:i]
            first, held = i, 0
        held += len(t) + 1
    if first < len(texts):
        yield first, texts[first:]


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of some texts, with 64-bit hashes."""

    def __init__(self, texts: list[bytes], lower: bool = True):
        self.buf, self.doc_start, self.doc_end = joined(texts)
        if lower:
            self.buf = TO_LOWER[self.buf]
        solid = np.zeros(len(self.buf) + 2, np.int8)
        solid[1:-1] = ~IS_SPACE[self.buf]
        edge = np.diff(solid)
        self.start = np.flatnonzero(edge == 1)
        self.end = np.flatnonzero(edge == -1)
        self.hash = span_hash(prefix_sums(self.buf), self.start, self.end)
        #: Words of text i are those from ``first[i]`` up to ``first[i + 1]``.
        self.first = np.append(np.searchsorted(self.start, self.doc_start), len(self.start))
        self.count = np.diff(self.first)

    def shingles(self, k: int) -> np.ndarray:
        """Hash of the ``k`` words from each place on; meaningless where the text ends earlier."""
        n = len(self.hash)
        out = np.zeros(n, U64)
        for j in range(min(k, n)):
            out[: n - j] += self.hash[j:] * PLACE_CODES[j]
        return mix64(out + U64(k))


def distinct_shingles(texts: list[bytes], k: int) -> list[np.ndarray]:
    """The sorted distinct ``k``-word shingle hashes of each text.

    A text of fewer than ``k`` words has its whole word sequence as its one
    shingle; a text without words has none.
    """
    out: list[np.ndarray] = []
    for _, part in chunks(texts):
        words = Words(part)
        full = words.shingles(k)
        for lo, n in zip(words.first[:-1].tolist(), words.count.tolist()):
            if n >= k:
                s = np.sort(full[lo : lo + n - k + 1])
                out.append(s[np.append(True, s[1:] != s[:-1])])
            elif n:
                out.append(mix64((words.hash[lo : lo + n] * PLACE_CODES[:n]).sum(dtype=U64, keepdims=True) + U64(n)))
            else:
                out.append(np.empty(0, U64))
    return out


def groups_of(texts: list[bytes], limit: int) -> Iterator[list[bytes]]:
    """As ``chunks``, without the places."""
    for _, part in chunks(texts, limit):
        yield part
