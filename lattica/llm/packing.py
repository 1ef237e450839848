"""Sum-of-squares packing of documents into sequences of a fixed length.

Each document goes where the sum over residual gaps of the squared number of
open sequences with that gap becomes smallest. Pieces are packed in groups of
similar size, in parallel; sequences that stay open with a large gap give their
pieces back, and these are packed again together in later rounds.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import runtime, vocab

LENGTH = 2048
#: Pieces that one task packs; enough of them that its open sequences hardly count.
GROUP_PIECES = 20_000


def pack(lengths: np.ndarray, size: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum-of-squares packing of ``lengths`` (each 1 to ``size``), longest first.

    Returns each one's sequence number and offset, and the gap left in each
    sequence. Among equal sums the smaller gap wins.
    """
    n = len(lengths)
    where, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    open_count = np.zeros(size + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(size + 1)]
    gaps: list[int] = []
    # score[g]: change of the sum when an open sequence of gap g takes a piece leaving gap g - s
    for i in np.argsort(-np.asarray(lengths), kind="stable").tolist():
        s = int(lengths[i])
        own = open_count[s:size]
        after = 2 * open_count[: size - s] + 1
        if size > s:
            after[0] = 0
            score = np.where(own > 0, after - 2 * own + 1, 1 << 60)
            g = int(score.argmin()) + s
            best = int(score[g - s])
        else:
            g, best = size, 1 << 60
        if best <= (2 * int(open_count[size - s]) + 1 if s < size else 0):
            k = stacks[g].pop()
            open_count[g] -= 1
        else:
            k, g = len(gaps), size
            gaps.append(size)
        where[i], offset[i] = k, size - g
        gaps[k] = g - s
        if g > s:
            stacks[g - s].append(k)
            open_count[g - s] += 1
    return where, offset, np.array(gaps, np.int64)


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, size: int = LENGTH, drops_space: bool = False) -> DataFrame:
    """Token pieces of ``docs(doc_id, text)``: the ids and ``end_id``, cut where longer than ``size``.

    The first piece of a cut document is the shorter one. Null text is empty and
    gives the end id alone. Rows stand alone: those with one ``doc_id``, and
    repeated ones, each give their own pieces, numbered from 0. Texts of any
    length are encoded whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = vocab.encoder(tokenizer, drops_space)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            out: list[tuple] = []
            for group in vocab.groups(batch.column("text").fill_null("").to_pylist()):
                for key, got in zip(keys, encoder.encode(group)):
                    got += end
                    n = len(got) // 4
                    a, b = 0, (n - 1) % size + 1
                    k = 0
                    while a < n:
                        out.append((key, k, a, b - a, zlib.crc32(got[4 * a : 4 * b])))
                        a, b, k = b, b + size, k + 1
                keys = keys[len(group) :]
            names = ("doc_id", "piece", "start", "length", "ids_crc32")
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            cols = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(runtime.trimmed(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_pieces(cut: DataFrame, size: int = LENGTH, group_pieces: int = GROUP_PIECES, rounds: int = 2) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a stored table of pieces.

    Full pieces are sequences of their own. The others are packed in
    ``rounds`` rounds; a round's groups hold about ``group_pieces`` pieces, dealt
    by a hash, so that no group depends on the order of the rows. Before the
    last round, sequences with a gap above 1/64 of ``size`` are opened again. A
    sequence number holds its round, group and place.
    """
    spark = cut.sparkSession
    names = [f.name for f in cut.schema]

    def packing(r: int, groups: int):
        def packed(batches: pa.Table) -> pa.Table:
            order = batches.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("start", "ascending")])
            where, offset, gaps = pack(order.column("length").to_numpy(), size)
            group = order.column("packing_group")[0].as_py()
            number = (np.int64(r + 1) << np.int64(56)) + where * groups + group
            return order.append_column("sequence_id", pa.array(number)).append_column("offset", pa.array(offset)).append_column("gap", pa.array(gaps[where]))

        return packed

    full = cut.filter(F.col("length") == size)
    done = [full.select(*names, F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    left = cut.filter(F.col("length") < size)
    for r in range(rounds):
        groups = max(1, round(left.count() / group_pieces))
        given = left.withColumn("packing_group", F.pmod(F.xxhash64("doc_id", "piece", F.lit(r)), F.lit(groups)).cast("int"))
        schema = T.StructType([*given.schema, *(T.StructField(c, T.LongType()) for c in ("sequence_id", "offset", "gap"))])
        result = given.repartition(groups, "packing_group").groupBy("packing_group").applyInArrow(packing(r, groups), schema)
        if r + 1 < rounds:
            result = runtime.stored(spark, result, f"packed-{r}")
            left = result.filter(F.col("gap") > size // 64).select(*names)
            result = result.filter(F.col("gap") <= size // 64)
        done.append(result.select(*names, "sequence_id", "offset"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, size: int = LENGTH) -> DataFrame:
    """Pack whole documents: one row per piece with its place.

    Pieces of equal length are dealt with in order of document, piece and start.
    Columns of ``docs`` other than ``doc_id`` and ``text`` are not looked at; an
    empty table gives no rows.
    """
    runtime.prepare(docs.sparkSession)
    return pack_pieces(runtime.stored(docs.sparkSession, pieces(docs, tokenizer, end_id, size), "pieces"), size)
