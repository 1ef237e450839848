"""Scoring of texts by an n-gram model kept in a log-frequency Bloom filter.

Words (lower-cased A-Z) and one end mark a text are the tokens. Texts are stored
as blocks. One pass deals the distinct single tokens and pairs of each block by
hash, with their counts in training texts. Where a bucket's counts meet, its
slice of the filter is made of all of them, and every block's tokens and pairs
are answered: exact counts of single tokens, and levels found in the slice. The
answers go back to the blocks, whose texts they score. No count is left out of
the filter and no part of it is broadcast, so it grows with the input.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import log_bloom, runtime
from .textblocks import IS_SPACE, U64, Words, column_bytes, groups_of, joined, mix64

#: Weight of the single-token model within a pair's context.
WEIGHT = 8.0
_END = U64(0x2545F4914F6CDD1D)
_KEPT = U64((1 << 48) - 1)
_UNIT = float(1 << 38)
_GROUP = 4 << 20
#: Blocks are compressed already, and too large for a codec's buffers over a page of many.
_FILES = {"compression": "none", "parquet.page.row.count.limit": "1"}
#: Tokens of all blocks, held-out ones included, for each bucket: a bucket's counts take about 60 bytes a token where they meet.
BUCKET_TOKENS = 1 << 21


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts in a row, each closed by the end mark; tokens of each text."""
    words = Words(texts)
    count = words.count + 1
    ends = np.cumsum(count) - 1
    out = np.full(int(count.sum()), _END, U64)
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner] = words.hash
    return out, count


def token_count(texts: list[bytes]) -> int:
    """Number of tokens of all texts, without hashing them."""
    space = IS_SPACE[joined(texts)[0]]  # each text ends in a space there
    return int(np.count_nonzero(space[1:] & ~space[:-1])) + len(texts)


def pairs(token: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Hash of each token with the one before it; a text's first token follows the end mark."""
    before = np.append(_END, token[:-1])
    return mix64(before * U64(0x9E3779B97F4A7C15) + (token ^ (token >> U64(29))))


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """By the upper bits, which don't travel with a pair; by all of them where those are too few."""
    return ((h >> U64(48) if buckets <= 1 << 14 else mix64(h)) % U64(buckets)).astype(np.int64)


def _cuts(bucket: np.ndarray, buckets: int) -> np.ndarray:
    return np.searchsorted(bucket, np.arange(buckets + 1))


def _by(bucket: np.ndarray) -> np.ndarray:
    return np.argsort(bucket.astype(np.uint16) if bucket.max(initial=0) < 1 << 16 else bucket, kind="stable")


class Items:
    """Distinct tokens and pairs of a block of texts, in the order in which they are dealt.

    Tokens stand by bucket; pairs by bucket, then by whether training texts have
    them never, once or more often.
    """

    def __init__(self, texts: list[bytes], train: np.ndarray, buckets: int):
        token, self.count = tokens(texts)
        teaches = np.repeat(train, self.count)
        kinds, at = np.unique(token, return_inverse=True)
        bucket = _bucket(kinds, buckets)
        order = _by(bucket)
        self.kind, self.kind_cut, self.at = kinds[order], _cuts(bucket[order], buckets), _inverse(order)[at]
        self.learned = np.bincount(self.at[teaches], minlength=len(kinds))
        pair, back = np.unique(pairs(token, self.count), return_inverse=True)
        times = np.bincount(back[teaches], minlength=len(pair))
        bucket = _bucket(pair, buckets)
        order = _by(bucket * 4 + np.minimum(times, 2))
        self.pair, self.pair_cut, self.back, self.times = pair[order], _cuts(bucket[order], buckets), _inverse(order)[back], times[order]

    def filled(self) -> list[int]:
        """Buckets into which something falls."""
        return np.flatnonzero((np.diff(self.kind_cut) > 0) | (np.diff(self.pair_cut) > 0)).tolist()

    def dealt(self, b: int) -> bytes:
        """What bucket ``b`` gets; empty where nothing falls into it."""
        k, p = slice(*self.kind_cut[b : b + 2]), slice(*self.pair_cut[b : b + 2])
        times = self.times[p]
        if not len(times) and k.start == k.stop:
            return b""
        head = struct.pack("<IIII", k.stop - k.start, *np.bincount(np.minimum(times, 2), minlength=3).tolist())
        return head + self.kind[k].tobytes() + self.learned[k].astype("<u4").tobytes() + self.pair[p].view(np.uint8).reshape(-1, 8)[:, :6].tobytes() + times[times > 1].astype("<u4").tobytes()


def _inverse(order: np.ndarray) -> np.ndarray:
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order))
    return out


def _asked(data: memoryview) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, their counts, pairs, their counts: what one block dealt."""
    k, zero, one, more = struct.unpack_from("<IIII", data)
    n, p = zero + one + more, 16 + 12 * k
    raw = np.zeros((n, 8), np.uint8)
    raw[:, :6] = np.frombuffer(data, np.uint8, 6 * n, p).reshape(-1, 6)
    times = np.concatenate([np.zeros(zero, np.int64), np.ones(one, np.int64), np.frombuffer(data, "<u4", more, p + 6 * n).astype(np.int64)])
    return np.frombuffer(data, U64, k, 16), np.frombuffer(data, "<u4", k, 16 + 8 * k), raw.view(U64).ravel(), times


def _blocks(docs: DataFrame) -> DataFrame:
    """Texts in blocks: ids, marks of held-out texts, sizes, compressed bytes and the number of tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd = pa.Codec("zstd", 1)
        for batch in batches:
            at = 0
            for part in groups_of(column_bytes(batch.column("text")), _GROUP):
                own = batch.slice(at, len(part))
                at += len(part)
                whole = b"".join(part)
                yield pa.RecordBatch.from_pydict({
                    "ids": pa.array([own.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                    "held": pa.array([own.column("held_out").to_pylist()], pa.list_(pa.bool_())),
                    "sizes": pa.array([[len(t) for t in part]], pa.list_(pa.int64())),
                    "texts": pa.array([zstd.compress(whole, asbytes=True) if whole else b""], pa.binary()),
                    "tokens": pa.array([token_count(part)], pa.int64()),
                })

    return docs.mapInArrow(runtime.trimmed(run), "ids array<long>, held array<boolean>, sizes array<long>, texts binary, tokens long")


def _texts_of(sizes: list[int], packed: bytes) -> list[bytes]:
    ends = np.cumsum(sizes).tolist()
    whole = pa.Codec("zstd").decompress(packed, ends[-1], asbytes=True) if ends[-1] else b""
    return [whole[e - n : e] for n, e in zip(sizes, ends)]


def _dealt(blocks: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                block, held, sizes, texts = (batch.column(c)[i].as_py() for c in ("block", "held", "sizes", "texts"))
                items = Items(_texts_of(sizes, texts), ~np.array(held, bool), buckets)
                sent = {b: items.dealt(b) for b in items.filled()}
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(list(sent), pa.int32()), "block": pa.array([block] * len(sent), pa.int64()), "items": pa.array(list(sent.values()), pa.binary())})

    return blocks.select("block", "held", "sizes", "texts").mapInArrow(runtime.trimmed(run), "bucket int, block long, items binary")


_MET = "block long, bucket int, answer binary, tokens long, kinds long"


def _met(table: pa.Table) -> pa.Table:
    """One bucket: its slices of the filter, what they answer each block, and numbers of tokens and kinds."""
    parts = [_asked(memoryview(data.as_buffer())) for data in table.column("items")]
    kind, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    total = np.bincount(at, np.concatenate([p[1] for p in parts]), len(kind)).astype(np.int64)
    pair, back = np.unique(np.concatenate([p[2] for p in parts]), return_inverse=True)
    times = np.bincount(back, np.concatenate([p[3] for p in parts]), len(pair)).astype(np.int64)
    one, two = (_found(x, n) for x, n in ((kind & _KEPT, total), (pair, times)))
    answers, k, p = [], 0, 0
    for kinds, _, asked, _ in parts:
        own, k = at[k : k + len(kinds)], k + len(kinds)
        pairs_own, p = back[p : p + len(asked)], p + len(asked)
        answers.append(total[own].astype("<i8").tobytes() + one[own].tobytes() + two[pairs_own].tobytes())
    bucket = table.column("bucket")[0].as_py()
    none = [None] * len(answers)
    cols = (table.column("block").to_pylist() + [None], [bucket] * (len(answers) + 1), answers + [None], none + [int(total.sum())], none + [int((total > 0).sum())])
    types = (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
    return pa.table([pa.array(c, t) for c, t in zip(cols, types)], [c.split()[0] for c in _MET.split(", ")])


def _found(items: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Levels that a slice of all counted items has for each item."""
    taught = counts > 0
    made = log_bloom.Filter([log_bloom.build(items[taught], counts[taught])])
    return made.levels(items, np.zeros(len(items), np.int64)).astype(np.uint8)


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scored(block: pa.Table, answers: pa.Table, n: int, v: int, buckets: int, weight: float = WEIGHT) -> pa.Table:
    """Scores of one block's texts: pairs are smoothed, ``(c(vw) + k p(w)) / (c(v) + k)``."""
    ids, held, sizes, texts = (block.column(c)[0].as_py() for c in ("ids", "held", "sizes", "texts"))
    items = Items(_texts_of(sizes, texts), ~np.array(held, bool), buckets)
    total, one, two = np.empty(len(items.kind), np.int64), np.empty(len(items.kind), np.uint8), np.empty(len(items.pair), np.uint8)
    done = 0
    for b, data in zip(answers.column("bucket").to_pylist(), answers.column("answer")):
        data = memoryview(data.as_buffer())
        k, p = slice(*items.kind_cut[b : b + 2]), slice(*items.pair_cut[b : b + 2])
        m = k.stop - k.start
        total[k], one[k], two[p] = np.frombuffer(data, "<i8", m), np.frombuffer(data, np.uint8, m, 8 * m), np.frombuffer(data, np.uint8, offset=9 * m)
        done += m + p.stop - p.start
    if done != len(items.kind) + len(items.pair):
        raise ValueError(f"answers for {done} of {len(items.kind) + len(items.pair)} tokens and pairs of a block")
    single = log_bloom.middle(one.astype(np.int64))
    c = single[items.at]
    context = np.append(single[items.kind == _END], c[:-1])
    double = np.minimum(log_bloom.middle(two.astype(np.int64))[items.back], np.minimum(c, context))  # no pair is more frequent than its tokens
    first = np.cumsum(items.count) - items.count
    score = np.add.reduceat(np.log10((double + weight * (c + 1) / (n + v + 1)) / (context + weight)), first)
    logs = np.add.reduceat(np.rint(np.log10(total + 1.0) * _UNIT).astype(np.int64)[items.at], first)
    known = np.add.reduceat((total > 0).astype(np.int64)[items.at], first)
    cols = (ids, held, items.count, known, np.full(len(ids), n), logs / _UNIT - items.count * np.log10(n + v + 1), score)
    types = (pa.int64(), pa.bool_(), *[pa.int64()] * 3, *[pa.float64()] * 2)
    return pa.table([pa.array(x, t) for x, t in zip(cols, types)], [x.split()[0] for x in _SCORED.split(", ")])


def score_documents(docs: DataFrame, folds: int = 7, held: int = 2) -> DataFrame:
    """Score every text; those with ``crc32(doc_id) % folds != held`` teach the model.

    Null text is empty and has the end mark only. Rows with equal ``doc_id`` are
    texts of their own.
    """
    spark = docs.sparkSession
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold == held).alias("held_out"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    runtime.prepare(spark)
    blocks = runtime.stored(spark, _blocks(keyed).withColumn("block", F.monotonically_increasing_id()), "blocks", _FILES)
    # by what falls into them, since the splits of a large input grow with it
    buckets = max(4, runtime.input_splits(docs) * 3 // 2, -(-(blocks.agg(F.sum("tokens")).first()[0] or 0) // BUCKET_TOKENS))
    met = runtime.stored(spark, _dealt(blocks, buckets).repartition(buckets, "bucket").groupBy("bucket").applyInArrow(runtime.lean(_met), _MET), "counts")
    n, v = (x or 0 for x in met.agg(F.sum("tokens"), F.sum("kinds")).first())

    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        out = _scored(block, answers, n, v, buckets)
        runtime.release()
        return out

    answers = met.filter("block IS NOT NULL").select("block", "bucket", "answer").repartition(buckets, "block")
    return blocks.repartition(buckets, "block").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, _SCORED)
