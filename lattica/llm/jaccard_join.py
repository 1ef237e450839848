"""Exact near-duplicate join on word shingles, by prefix filters under several orders.

Two documents link when ``denominator * |A & B| >= numerator * |A | B|``. Then,
whatever total order all shingles are put in, the first
``|A| - ceil(t |A|) + 1`` shingles of either have one in common with the other's.
Candidates must pass that test under each of these orders:

1. by document frequency (then by hash): the rarest first, found by a join;
2. by hash, with shingles that occur once before all others;
3. by another hash, likewise.

A join of prefixes under order 1 makes the pairs; a join with the prefixes under
orders 2 and 3 leaves those that share a token in every one. Only then do the
whole sets travel to be verified.

Documents with equal sets form a class first, and all that follows works on
classes, so copies never meet in pairs. Shingles that occur in one class only
match nothing; a class of which fewer than ``t |A|`` shingles occur elsewhere has
no partner and goes before any join. Near copies are linked in two steps: every
class of a posting list is compared with one pivot, and then only pairs in
different components are left to compare, within bands of possible sizes, so a
large group of near copies does not become all its pairs. There, too, a bitmap of token parities bounds
from below how many tokens two sets do not share, and a posting's place in its
prefix bounds from above how many they do.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime
from .components import extended
from .textblocks import U64, column_bytes, distinct_shingles, groups_of, mix64

_TOKEN_BYTES = 6
_TOKEN_MASK = U64((1 << 8 * _TOKEN_BYTES) - 1)
_HEAD, _HEAD_BYTES = "<II", 8
#: Longs of a class's parity bitmap: bit i says whether an odd number of its shared tokens falls into bucket i.
BITMAP_LONGS = 16
#: Rounds in which every posting list is compared with one pivot, before the remaining pairs are taken.
STAR_ROUNDS = 2


@dataclass(frozen=True)
class Similarity:
    """Words in a shingle, and the least Jaccard similarity as a fraction."""

    words: int = 5
    numerator: int = 3
    denominator: int = 4

    def least_shared(self, n: np.ndarray) -> np.ndarray:
        return -(-n * self.numerator // self.denominator)


def _class_key(s: np.ndarray) -> int:
    """64 bits of the whole set; with the set's size they name its class."""
    h = mix64(s + U64(0x5851F42D4C957F2D))
    return int(mix64(np.array([h.sum(dtype=U64) ^ (U64(len(s)) << U64(40))], U64))[0].astype(np.int64))


def classes(docs: DataFrame, how: Similarity) -> DataFrame:
    """Per document: a hash of its text, the size of its shingle set and the key of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = distinct_shingles(column_bytes(batch.column("text")), how.words)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "row": batch.column("row"), "n": pa.array([len(s) for s in sets], pa.int64()), "key": pa.array([_class_key(s) for s in sets], pa.int64())})

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row"), "text").mapInArrow(runtime.trimmed(run), "doc_id long, row long, n long, key long")


def _pack(tokens: np.ndarray) -> bytes:
    return np.ascontiguousarray(tokens).view(np.uint8).reshape(-1, 8)[:, :_TOKEN_BYTES].tobytes()


def _unpack(data: bytes | memoryview) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, _TOKEN_BYTES)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :_TOKEN_BYTES] = raw
    return out.view(U64).ravel()


def _bucket(tokens: np.ndarray, buckets: int) -> np.ndarray:
    """A bucket by hash bits; the upper ones of a token, which don't travel, serve for up to 2**14 buckets."""
    upper = tokens >> U64(8 * _TOKEN_BYTES)
    if buckets > 1 << 14:  # 16 bits don't deal evenly to so many
        upper = mix64(tokens)
    return (upper % U64(buckets)).astype(np.int64 if buckets > 1 << 16 else np.uint16)


def _blocks(docs: DataFrame, how: Similarity, buckets: int) -> DataFrame:
    """Shingles dealt by hash, as packed blocks: class keys, set sizes, counts, then tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in groups_of(column_bytes(batch.column(0)), 6 << 20):
                sets: dict[tuple[int, int], np.ndarray] = {}
                for s in distinct_shingles(texts, how.words):
                    if len(s):
                        sets[_class_key(s), len(s)] = s
                if not sets:
                    continue
                keys = np.array([k for k, _ in sets], np.int64)
                sizes = np.array([n for _, n in sets], np.uint32)
                tokens = np.concatenate(list(sets.values()))
                bucket = _bucket(tokens, buckets)
                owner = np.repeat(np.arange(len(keys), dtype=np.int64), sizes)
                order = np.argsort(bucket, kind="stable")
                rows_b, rows_p = [], []
                for b, part in zip(*_runs(bucket[order], order)):
                    counts = np.bincount(owner[part], minlength=len(keys))
                    have = np.flatnonzero(counts)
                    rows_b.append(int(b))
                    rows_p.append(struct.pack(_HEAD, len(have), len(part)) + keys[have].tobytes() + sizes[have].tobytes() + counts[have].astype("<u4").tobytes() + _pack(tokens[part]))
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(rows_b, pa.int32()), "payload": pa.array(rows_p, pa.binary())})

    return docs.select("text").mapInArrow(runtime.trimmed(run), "bucket int, payload binary")


def _shared(table: pa.Table, out_buckets: int) -> pa.Table:
    """Of one bucket's tokens, those in several classes, with their numbers of classes, dealt by class."""
    payload = table.column("payload")
    heads = []
    for data in payload:
        raw = data.as_buffer()
        n, m = struct.unpack_from(_HEAD, raw)
        heads.append((np.frombuffer(raw, np.int64, n, _HEAD_BYTES), np.frombuffer(raw, np.uint32, n, _HEAD_BYTES + 8 * n), np.frombuffer(raw, np.uint32, n, _HEAD_BYTES + 12 * n), m))
    key, size = (np.concatenate([h[i] for h in heads]) for i in (0, 1))
    pair = np.stack([key.view(U64), size.astype(U64)], 1)
    _, first, cls = np.unique(pair, axis=0, return_index=True, return_inverse=True)
    once = np.zeros(len(key), bool)
    once[first] = True  # a class that several tasks sent counts once
    cls = cls.ravel().astype(np.int32)
    token_parts, owner_parts, at = [], [], 0
    for data, (k, _, count, m) in zip(payload, heads):
        keep = np.repeat(once[at : at + len(k)], count)
        token_parts.append(_unpack(memoryview(data.as_buffer())[_HEAD_BYTES + 16 * len(k) :])[keep])
        owner_parts.append(np.repeat(cls[at : at + len(k)], count)[keep])
        at += len(k)
    token, owner = np.concatenate(token_parts), np.concatenate(owner_parts)
    del token_parts, owner_parts
    order = np.argsort(token)
    token, owner = token[order], owner[order]
    del order
    edge = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
    df = np.diff(np.append(edge, len(token)))
    df = np.repeat(df.astype(np.int32), df)
    several = df > 1
    token, owner, df = token[several], owner[several], df[several]
    order = np.argsort(owner, kind="stable")
    token, owner, df = token[order], owner[order], df[order]
    edge = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.empty(0, np.int64)
    n_own = np.diff(np.append(edge, len(owner)))
    k, s = key[first[owner[edge]]], size[first[owner[edge]]]
    to = (k.view(U64) % U64(out_buckets)).astype(np.int64)
    rows_b, rows_p = [], []
    by = np.argsort(to, kind="stable")
    for b, part in zip(*_runs(to[by], by)):
        idx = np.concatenate([np.arange(edge[i], edge[i] + n_own[i]) for i in part])
        rows_b.append(int(b))
        rows_p.append(struct.pack(_HEAD, len(part), len(idx)) + k[part].tobytes() + s[part].tobytes() + n_own[part].astype("<u4").tobytes() + df[idx].astype("<u4").tobytes() + _pack(token[idx]))
    return pa.table({"bucket": pa.array(rows_b, pa.int32()), "payload": pa.array(rows_p, pa.binary())})


def _runs(sorted_values: np.ndarray, carried: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    if not len(sorted_values):
        return sorted_values, []
    edge = np.flatnonzero(np.append(True, sorted_values[1:] != sorted_values[:-1]))
    return sorted_values[edge], np.split(carried, edge[1:])


def _prefixes(table: pa.Table, how: Similarity) -> pa.Table:
    """Classes that can have a partner: shared tokens (sorted) and the prefix under order 1."""
    found: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
    for data in table.column("payload").to_pylist():
        n, m = struct.unpack_from(_HEAD, data)
        p = _HEAD_BYTES
        keys = np.frombuffer(data, np.int64, n, p).tolist()
        sizes = np.frombuffer(data, np.uint32, n, p + 8 * n).tolist()
        ends = np.frombuffer(data, np.uint32, n, p + 12 * n).cumsum().tolist()
        df = np.frombuffer(data, np.uint32, m, p + 16 * n)
        token = _unpack(memoryview(data)[p + 16 * n + 4 * m :])
        a = 0
        for k, s, b in zip(keys, sizes, ends):
            found.setdefault((k, s), []).append((df[a:b], token[a:b]))
            a = b
    rows = []
    for (k, n), parts in found.items():
        df, token = (np.concatenate(x) for x in zip(*parts))
        length = len(token) - int(how.least_shared(np.int64(n))) + 1
        if length < 1:
            continue
        first = np.lexsort((token, df))[:length]
        rest = [_prefix(token, length, other).astype(np.uint32).view(np.int32).tolist() for other in (False, True)]
        rows.append((k, n, len(token), _pack(np.sort(token)), _bitmap(token), token[first].astype(np.int64).tolist(), *rest))
    cols = list(zip(*rows)) if rows else [[]] * 8
    types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()))
    return pa.table([pa.array(c, t) for c, t in zip(cols, types)], [c.split()[0] for c in _CLASS.split(", ")])


_CLASS = "key long, n long, shared long, tokens binary, bitmap array<long>, prefix array<long>, prefix2 array<int>, prefix3 array<int>"


def _bitmap(tokens: np.ndarray) -> list[int]:
    bits = 64 * BITMAP_LONGS
    bucket = (mix64(tokens ^ U64(0x6A09E667F3BCC909)) % U64(bits)).astype(np.int64)
    odd = (np.bincount(bucket, minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<i8").tolist()


def _prefix(tokens: np.ndarray, length: int, other: bool) -> np.ndarray:
    """The first ``length`` tokens under order 2 or, if ``other``, order 3."""
    rank = mix64(tokens ^ U64(0xA0761D6478BD642F)) if other else tokens
    return tokens if length >= len(tokens) else tokens[np.argpartition(rank, length - 1)[:length]]


def verified(a: np.ndarray, n: int, b: np.ndarray, m: int, how: Similarity) -> bool:
    """The exact test, on the sorted shared tokens of two sets of sizes n and m."""
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return how.denominator * shared >= how.numerator * (n + m - shared)


def filtered(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """Of ``pairs(a, b)`` that share a prefix token under order 1, those that share one under orders 2 and 3, too."""
    sides = [table.select(*(F.col(c).alias(f"{s}_{c}") for c in ("key", "prefix2", "prefix3"))) for s in "ab"]
    joined = pairs.join(sides[0], pairs.a == F.col("a_key")).join(sides[1], pairs.b == F.col("b_key"))
    return joined.filter(F.arrays_overlap("a_prefix2", "b_prefix2") & F.arrays_overlap("a_prefix3", "b_prefix3")).select("a", "b")


def _verify(pairs: DataFrame, table: DataFrame, how: Similarity) -> DataFrame:
    """Of candidate ``pairs(a, b)`` of classes, those that link."""
    pairs = filtered(pairs, table)
    sides = [table.select(*(F.col(c).alias(f"{s}_{c}") for c in ("key", "n", "tokens"))) for s in "ab"]
    joined = pairs.join(sides[1], pairs.b == F.col("b_key")).join(sides[0], pairs.a == F.col("a_key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = {c: batch.column(c).to_pylist() for c in batch.schema.names}
            held: dict[int, np.ndarray] = {}

            def tokens(k: int, data: bytes) -> np.ndarray:
                if k not in held:
                    held[k] = _unpack(data)
                return held[k]

            ok = [verified(tokens(a, x), n, tokens(b, y), m, how) for a, x, n, b, y, m in zip(d["a"], d["a_tokens"], d["a_n"], d["b"], d["b_tokens"], d["b_n"])]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return joined.select("a", "b", "a_n", "a_tokens", "b_n", "b_tokens").mapInArrow(runtime.trimmed(run), "a long, b long")


def class_links(docs: DataFrame, how: Similarity = Similarity()) -> tuple[DataFrame, DataFrame]:
    """Links between classes that connect all that is linked, and the roots of linked classes.

    The links are a subset of all similar pairs of classes, with the same
    components.
    """
    spark = docs.sparkSession
    runtime.prepare(spark)
    buckets = max(4, 2 * runtime.input_splits(docs))
    blocks = _blocks(docs, how, buckets)
    shared = blocks.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(runtime.lean(_shared, buckets), "bucket int, payload binary")
    table = runtime.stored(spark, shared.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(runtime.lean(_prefixes, how), _CLASS), "classes")
    postings = table.select("key", "n", "shared", F.posexplode("prefix").alias("pos", "token"))
    num, den = how.numerator, how.denominator
    # what two sets share is bounded by what each shares with anyone
    fits = (F.col("n") * den >= F.col("m") * num) & (F.col("m") * den >= F.col("n") * num)
    fits &= F.least("shared", "m_shared") * (num + den) >= (F.col("n") + F.col("m")) * num

    def with_roots(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
        if roots is None:
            return rows.withColumn("root", F.col("key"))
        return rows.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))

    links = roots = tried = None
    for r in range(STAR_ROUNDS):
        held = with_roots(postings, roots)
        pivot = F.min_by(F.struct(F.col("key").alias("p"), F.col("n").alias("m"), F.col("shared").alias("m_shared"), F.col("root").alias("p_root")), F.xxhash64("key", F.lit(r)))
        lists = held.groupBy("token").agg(pivot.alias("pivot"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high").select("token", "pivot.*")
        met = held.join(lists, "token").filter((F.col("root") != F.col("p_root")) & fits)
        pairs = met.select(F.least("key", "p").alias("a"), F.greatest("key", "p").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = runtime.stored(spark, pairs, "pairs")
        if pairs.isEmpty():
            continue
        tried = pairs if tried is None else tried.unionByName(pairs)
        new = runtime.stored(spark, _verify(pairs, table, how), "similar")
        links = new if links is None else links.unionByName(new)
        roots = extended(roots, new)
    # all pairs across components: at least one side is not of its list's most frequent component
    held = runtime.stored(spark, with_roots(postings, roots), "postings")
    by_root = held.groupBy("token", "root").agg(F.count("*").alias("size"))
    lists = by_root.groupBy("token").agg(F.max_by("root", F.struct("size", "root")).alias("main"), F.count("*").alias("roots")).filter("roots > 1").select("token", "main")
    band = lambda size: F.floor(F.log(size.cast("double")) / F.log(F.lit(1.08)))
    low = F.ceil(F.col("n") * num / den)
    high = F.least(F.floor(F.col("n") * den / num), F.floor(F.col("shared") * (num + den) / num) - F.col("n"))
    # buckets in which the parities differ each hold a token that only one side has
    bits = table.select("key", *(F.element_at("bitmap", i + 1).alias(f"b{i}") for i in range(BITMAP_LONGS)))
    open_lists = held.join(lists, "token").join(bits, "key")
    one = open_lists.filter((F.col("root") != F.col("main")) & (high >= low)).withColumn("band", F.explode(F.sequence(band(F.greatest(low, F.lit(1))), band(high))))
    named = {"key": "o_key", "n": "m", "shared": "m_shared", "root": "o_root", "pos": "o_pos"} | {f"b{i}": f"o_b{i}" for i in range(BITMAP_LONGS)}
    other = open_lists.select("token", *(F.col(k).alias(v) for k, v in named.items()), band(F.col("n")).alias("band"))
    differ = F.col("n") - F.col("shared") + F.col("m") - F.col("m_shared")
    for i in range(BITMAP_LONGS):
        differ = differ + F.bit_count(F.col(f"b{i}").bitwiseXOR(F.col(f"o_b{i}")))
    close = differ * (num + den) <= (F.col("n") + F.col("m")) * (den - num)
    # at the first token that two sets share, what is left of both bounds what they share
    ahead = F.least(F.col("shared") - F.col("pos"), F.col("m_shared") - F.col("o_pos")) * (num + den) >= (F.col("n") + F.col("m")) * num
    met = one.join(other, ["token", "band"]).filter((F.col("root") != F.col("o_root")) & fits & ahead & close)
    rest = met.select(F.least("key", "o_key").alias("a"), F.greatest("key", "o_key").alias("b")).distinct()
    rest = runtime.stored(spark, rest if tried is None else rest.join(tried, ["a", "b"], "left_anti"), "pairs")
    if not rest.isEmpty():
        new = runtime.stored(spark, _verify(rest, table, how), "similar")
        links, roots = (new if links is None else links.unionByName(new)), extended(roots, new)
    if links is None:
        return spark.createDataFrame([], "a long, b long"), spark.createDataFrame([], "node long, root long")
    return links, roots


def _labelled(docs: DataFrame, how: Similarity) -> DataFrame:
    """``classes``, with the smallest ``doc_id`` that each document is linked to."""
    spark = docs.sparkSession
    own = runtime.stored(spark, classes(docs, how), "class-keys")
    _, roots = class_links(docs, how)
    full = own.filter("n > 0")
    smallest = full.groupBy("key", "n").agg(F.min("doc_id").alias("least"))
    smallest = runtime.stored(spark, smallest.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key")), "least")
    # stored by itself, so that a large component's rows may be split in the join
    by_root = runtime.stored(spark, smallest.groupBy("root").agg(F.min("least").alias("component_id")), "by-root")
    named = runtime.stored(spark, smallest.join(by_root, "root").select("key", "n", "component_id"), "named")
    return full.join(named, ["key", "n"]).unionByName(own.filter("n = 0").withColumn("component_id", F.col("doc_id")))


def near_duplicates(docs: DataFrame, how: Similarity = Similarity()) -> DataFrame:
    """Per document: ``n_shingles`` and ``component_id``, the smallest ``doc_id`` it is linked to.

    Words are split at ASCII white space after lower-casing A-Z. A document of
    fewer words than a shingle has its whole word sequence as one shingle; one
    without words (or null) has none and stays alone. Repeated rows and equal
    ids are rows of one class; a null ``doc_id`` names no component. Very long
    texts are one row of tokens; an empty table gives no rows.
    """
    return _labelled(docs, how).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, how: Similarity = Similarity()) -> DataFrame:
    """Documents whose ``doc_id`` names their component, all columns kept.

    Of rows that share this ``doc_id`` and their shingles one stays; unlike texts
    of one ``doc_id`` each stay. Documents without words are not linked with
    anything, so each stays (once, where id and text repeat); so do rows without
    a ``doc_id``, which cannot name a component.
    """
    found = _labelled(docs, how).filter("doc_id = component_id")
    keep = found.groupBy("doc_id", "key", "n", F.when(F.col("n") == 0, F.col("row")).alias("own")).agg(F.min("row").alias("row"))
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")
    keyed = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), whole)
    kept = keyed.join(keep.select("doc_id", "row").distinct(), ["doc_id", "row"], "left_semi").dropDuplicates(["doc_id", "row"])
    return kept.select("doc.*").unionByName(docs.filter(F.col("doc_id").isNull()))
