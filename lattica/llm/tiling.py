"""Benchmark decontamination by greedy string tiling.

Words shared with a benchmark item are found by joining short word seeds. For
each document and item that share one, tiles are laid greedily: the longest
common word runs are marked first, never overlapping, with running Karp-Rabin
hashes to find them. An item whose words are covered by tiles up to a share is
taken to be in the document, in whatever order its passages stand there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime
from .textblocks import U64, Words, chunks, column_bytes, mix64

#: Words of a seed and of the shortest tile; covered share of an item that counts; bytes of benchmark text broadcast at a time.
LEAST, SHARE, PART_BYTES = 5, 0.5, 16 << 20
#: Parts of the benchmark that one pass over the documents looks for.
PARTS_AT_ONCE = 3
#: Punctuation is read as white space.
_AS_WORDS = bytes(32 if 33 <= c <= 47 or 58 <= c <= 64 or 91 <= c <= 96 or 123 <= c <= 126 else c for c in range(256))
_RADIX = 0x9E3779B97F4A7C15 | 1
_TABLE_BITS = 20


def words_of(texts: list[bytes]) -> Words:
    return Words([t.translate(_AS_WORDS) for t in texts])


def _rolling(values: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hash of each run of ``size`` values."""
    n = len(values) - size + 1
    if n < 1:
        return np.empty(0, U64)
    out = np.zeros(n, U64)
    for k in range(size):
        out = out * U64(_RADIX) + values[k : k + n]
    return mix64(out)


def tiles(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiling of two word sequences: (place in item, place in doc, words), longest first.

    The search length starts high; where a longer match turns up, the search
    starts over from its length, else it is halved down to ``least``.
    """
    least = min(least, len(item))
    if not least:
        return []
    free_item, free_doc = np.ones(len(item), bool), np.ones(len(doc), bool)
    out: list[tuple[int, int, int]] = []
    size = max(least, min(20, len(item)))
    while True:
        found, longest = [], 0
        a, b = _rolling(item, size), _rolling(doc, size)
        whole = lambda free: np.convolve(free, np.ones(size, int), "valid") == size if len(free) >= size else np.empty(0, bool)
        ia = np.flatnonzero(whole(free_item))
        jb = np.flatnonzero(whole(free_doc) & np.isin(b, a[ia])) if len(b) else np.empty(0, int)
        at: dict[int, list[int]] = {}
        for i in ia.tolist():
            at.setdefault(int(a[i]), []).append(i)
        for j in jb.tolist():
            for i in at.get(int(b[j]), ()):
                k = 0
                while i + k < len(item) and j + k < len(doc) and free_item[i + k] and free_doc[j + k] and item[i + k] == doc[j + k]:
                    k += 1
                if k >= size:
                    found.append((k, i, j))
                    longest = max(longest, k)
        if longest > 2 * size:
            size = longest
            continue
        for k, i, j in sorted(found, key=lambda x: (-x[0], x[1], x[2])):
            if free_item[i : i + k].all() and free_doc[j : j + k].all():
                free_item[i : i + k] = free_doc[j : j + k] = False
                out.append((i, j, k))
        if found and any(free_item[i : i + size].all() and free_doc[j : j + size].all() for _, i, j in found):
            continue  # what is left of matches that were partly covered
        if size == least:
            return out
        size = max(least, size // 2)


@dataclass
class Seeds:
    """Items as word hashes, and their seeds sorted by hash, for each seed length."""

    ids: list[int]
    items: list[np.ndarray]
    by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def seeds(ids: list[int], texts: list[bytes], least: int = LEAST) -> Seeds:
    """Seeds of ``least`` words; an item of fewer words is its own seed."""
    words = words_of(texts)
    items = [words.hash[a:b] for a, b in zip(words.first[:-1], words.first[1:])]
    found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for k, item in enumerate(items):
        if len(item):
            size = min(least, len(item))
            h = _rolling(item, size)
            found.setdefault(size, []).append((h, np.full(len(h), k)))
    by_length = {}
    for size, parts in found.items():
        h, owner = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(h, kind="stable")
        table = np.zeros(1 << _TABLE_BITS, bool)
        table[(h >> U64(64 - _TABLE_BITS)).astype(np.int64)] = True
        by_length[size] = h[order], owner[order], table
    return Seeds(ids, items, by_length)


def matches(texts: list[bytes], bench: Seeds, least: int = LEAST) -> list[tuple[int, int, float, int]]:
    """(text, item, covered share, tiles) of all texts and items that share a seed."""
    words = words_of(texts)
    pairs: set[tuple[int, int]] = set()
    for size, (h, owner, table) in bench.by_length.items():
        own = _rolling(words.hash, size)
        hit = np.flatnonzero(table[(own >> U64(64 - _TABLE_BITS)).astype(np.int64)])
        lo, hi = np.searchsorted(h, own[hit], "left"), np.searchsorted(h, own[hit], "right")
        hit, lo, hi = (x[hi > lo] for x in (hit, lo, hi))
        text = np.searchsorted(words.first, hit, "right") - 1
        inside = hit + size <= words.first[text + 1]
        for t, a, b in zip(text[inside].tolist(), lo[inside].tolist(), hi[inside].tolist()):
            pairs.update((t, k) for k in owner[a:b].tolist())
    out = []
    for t, k in sorted(pairs):
        laid = tiles(bench.items[k], words.hash[words.first[t] : words.first[t + 1]], least)
        out.append((t, k, sum(x[2] for x in laid) / len(bench.items[k]), len(laid)))
    return out


def _parts(benchmark: DataFrame, least: int) -> Iterator:
    """The benchmark's seeds as broadcasts of about ``PART_BYTES`` of text each, made when asked for."""
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // PART_BYTES))
    for part in range(parts):
        rows = benchmark.filter(F.col("text").isNotNull() & (F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)).select(F.col("item_id").cast("long"), "text").collect()
        yield benchmark.sparkSession.sparkContext.broadcast(seeds([r["item_id"] for r in rows], [r["text"].encode() for r in rows], least))


_FOUND = "doc_id long, row long, row2 long, coverage double, best_item long, n_tiles int, n_items int"


def overlaps(docs: DataFrame, benchmark: DataFrame, least: int = LEAST) -> DataFrame:
    """Per document row: the best covered item, its share and tiles, and the number of items met.

    The benchmark is broadcast in parts of at most about ``PART_BYTES`` of text,
    one pass over ``docs`` for each, so no part outgrows a worker. Null or empty
    texts and items match nothing; among equal shares the smallest item id wins;
    repeated items are items of their own, and repeated rows of ``docs`` each
    give a row. An item of fewer than ``least`` words is found as a whole, so one
    of a single word is met in every text that has this word. Very long texts are
    one row; empty tables give no rows or no matches.
    """
    runtime.prepare(docs.sparkSession)
    found, parts = None, 0
    for shared in _parts(benchmark, least):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first, texts in chunks(column_bytes(batch.column("text"))):
                    best: dict[int, tuple[float, int, int]] = {}
                    met: dict[int, int] = {}
                    for t, k, share, n in matches(texts, shared.value, least):
                        item = shared.value.ids[k]
                        met[t] = met.get(t, 0) + 1
                        if t not in best or (-share, item) < (-best[t][0], best[t][1]):
                            best[t] = share, item, n
                    got = [best.get(t, (0.0, None, 0)) for t in range(len(texts))]
                    cols = [batch.column(c).slice(first, len(texts)) for c in batch.schema.names if c != "text"]
                    new = [pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int32()), pa.array([met.get(t, 0) for t in range(len(texts))], pa.int32())]
                    yield pa.RecordBatch.from_arrays([*cols, *new], [*(c for c in batch.schema.names if c != "text"), "coverage", "best_item", "n_tiles", "n_items"])

        keyed = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text", "doc_id").alias("row"), F.xxhash64(F.lit(1), "doc_id", "text").alias("row2"), "text")
        got = keyed.mapInArrow(runtime.trimmed(run), _FOUND)
        found, parts = got if found is None else found.unionByName(got), parts + 1
    if parts > 1:  # rows of one id and text share a key; each part has as many of them
        best = F.max_by(F.struct("best_item", "n_tiles"), F.struct("coverage", -F.col("best_item")))
        found = found.groupBy("doc_id", "row", "row2").agg(F.max("coverage").alias("coverage"), best.alias("b"), F.sum("n_items").alias("met"), F.count("*").alias("rows"))
        times = F.explode(F.sequence(F.lit(1), (F.col("rows") / parts).cast("int"))).alias("time")
        met = (F.col("met") * parts / F.col("rows")).cast("int").alias("n_items")
        found = found.select("doc_id", "row", "row2", "coverage", "b.best_item", "b.n_tiles", met, times).drop("time")
    return found


def decontaminated(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """The documents that hold no benchmark item, all columns kept.

    Each part of the benchmark filters the rows where they are; nothing is
    joined. After every few parts what is left is stored, so that few parts are
    in a worker's memory at a time.
    """
    runtime.prepare(docs.sparkSession)
    at, schema = docs.columns.index("text"), docs.schema
    for n, shared in enumerate(_parts(benchmark, least)):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(len(batch), bool)
                for first, texts in chunks(column_bytes(batch.column(at))):
                    clean[[first + t for t, _, covered, _ in matches(texts, shared.value, least) if covered >= share]] = False
                yield batch.filter(pa.array(clean))

        if n and n % PARTS_AT_ONCE == 0:
            docs = runtime.stored(docs.sparkSession, docs, "clean")
        docs = docs.mapInArrow(runtime.trimmed(run), schema)
    return docs
