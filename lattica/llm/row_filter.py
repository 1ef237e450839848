"""Rows that a join can match: told by a Bloom filter of their ids, before they move.

Every id of the set passes, and about one in a hundred of the others, which the
join drops. A slice of the filter that would outgrow its share of ``FILTER_BYTES``
lets all rows pass, so that what each task gets is bounded at any input size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime
from .textblocks import U64, mix64

BITS, HASHES = 10, 5
SLICES = 64
#: 26 million ids.
FILTER_BYTES = 32 << 20


def _places(ids: np.ndarray, j: int, bits: np.ndarray | U64) -> np.ndarray:
    return mix64(ids + U64(j * 0xC2B2AE3D27D4EB4F % (1 << 64))) % bits


def build(ids: np.ndarray, most_bytes: int) -> bytes:
    """A slice that all ``ids`` pass."""
    ids = np.unique(ids)
    size = max(1, -(-len(ids) * BITS // 8))
    if size > most_bytes:
        return b"\xff"
    on = np.zeros(8 * size, bool)
    for j in range(HASHES):
        on[_places(ids, j, U64(8 * size)).astype(np.int64)] = True
    return np.packbits(on, bitorder="little").tobytes()


class Filter:
    """Slices by their number; in one that is missing there are no ids."""

    def __init__(self, slices: dict[int, bytes]):
        data = [slices.get(k, b"\0") for k in range(SLICES)]
        sizes = np.array([len(d) for d in data], np.int64)
        self.data = np.frombuffer(b"".join(data), np.uint8)
        self.first = (np.cumsum(sizes) - sizes).astype(U64) * U64(8)
        self.bits = sizes.astype(U64) * U64(8)

    def passes(self, ids: np.ndarray) -> np.ndarray:
        out = np.ones(len(ids), bool)
        own = (ids % U64(SLICES)).astype(np.int64)
        for j in range(HASHES):
            at = _places(ids, j, self.bits[own]) + self.first[own]
            out &= (self.data[(at >> U64(3)).astype(np.int64)] >> (at & U64(7)).astype(np.uint8)) & 1 == 1
        return out


def _slice(table: pa.Table, most_bytes: int) -> pa.Table:
    ids = np.asarray(table.column("id")).view(U64)
    return pa.table({"slice": pa.array([int(ids[0] % U64(SLICES))], pa.int32()), "bits": pa.array([build(ids, most_bytes)], pa.binary())})


def passing(ids: DataFrame, column: str):
    """A test of the 64-bit hash ``column`` in other tables, which those in ``ids`` pass; ``ids`` is read at once."""
    spark = ids.sparkSession
    dealt = ids.select(F.col(column).alias("id"), F.pmod(F.col(column), F.lit(SLICES)).cast("int").alias("slice"))
    slices = dealt.groupBy("slice").applyInArrow(runtime.lean(_slice, FILTER_BYTES // SLICES), "slice int, bits binary").collect()
    made = spark.sparkContext.broadcast(Filter({r["slice"]: bytes(r["bits"]) for r in slices}))

    @F.arrow_udf("boolean")
    def test(column: pa.Array) -> pa.Array:
        return pa.array(made.value.passes(np.asarray(column).view(U64)))

    return test(F.col(column))
