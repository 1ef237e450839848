"""Quality classifier: histogram gradient-boosted trees over document statistics.

Trees are complete and flattened into arrays (feature, bin and leaf value by
node number), so scoring walks all rows of a batch one level at a time in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime
from .textblocks import chunks, column_bytes
from .textstats import Measures

#: Labelled rows that the model is fitted on, at most (those with the smallest hashes of their ids).
TRAIN_ROWS = 30_000
TREES, DEPTH, BINS, RATE, RIDGE = 80, 4, 64, 0.15, 1.0


def features(texts: list[bytes]) -> np.ndarray:
    """Statistics of each text, by row. None of them comes from labels or other columns."""
    m, rows = Measures(texts), np.arange(len(texts))
    b, w, li = m.get("bytes", rows), m.get("words", rows), m.get("lines", rows)
    words, chars, lines = np.maximum(w["n_words"], 1), np.maximum(b["chars"], 1), np.maximum(li["n_lines"], 1)
    cols = [
        np.log1p(w["n_words"]), b["word_chars"] / words, w["short_words"] / words, w["long_words"] / words, w["distinct_words"] / words,
        w["n_repeat_words"] / words, li["n_dup_lines"] / lines, np.log1p(li["n_lines"]), w["n_words"] / lines, np.log1p(li["longest_line"]),
        b["upper"] / np.maximum(b["upper"] + b["lower"], 1), b["stop"] / words, b["comma"] / words, b["exclaim"] / words, b["bar"] / words,
        *(b[k] / chars for k in ("digit", "symbol", "punct", "quote", "wide", "control", "blank", "other_space")),
    ]
    return np.stack([np.asarray(c, np.float64) for c in cols], 1)


@dataclass
class Trees:
    """A fitted model. ``edges``: the bin edges of each feature."""

    edges: list[np.ndarray]
    feature: np.ndarray
    split: np.ndarray
    leaf: np.ndarray
    start: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1).astype(np.int16)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        binned, rows = self.bins(x), np.arange(len(x))
        total = np.full(len(x), self.start)
        depth = self.leaf.shape[1].bit_length() - 1
        for t in range(len(self.leaf)):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (binned[rows, self.feature[t, node]] > self.split[t, node])
            total += self.leaf[t, node - (1 << depth) + 1]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Logistic boosting. Without rows, or with one label only, every score is the label's share (0.5 without rows)."""
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    start = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS)[1:-1])) for c in x.T] if len(x) else [np.empty(0)] * x.shape[1]
    model = Trees(edges, np.zeros((0, (1 << depth) - 1), np.int64), np.zeros((0, (1 << depth) - 1), np.int16), np.zeros((0, 1 << depth)), start)
    if not 0 < y.sum() < len(y):
        return model
    binned, d = model.bins(x).astype(np.int64), x.shape[1]
    total = np.full(len(y), start)
    out_f, out_s, out_l = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        feature, split = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, BINS, np.int16)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            best = np.full(width, 1e-6)
            for j in range(d):
                key = (node - first) * BINS + binned[:, j]
                gs = np.bincount(key, g, width * BINS).reshape(width, BINS).cumsum(1)
                hs = np.bincount(key, h, width * BINS).reshape(width, BINS).cumsum(1)
                ga, ha = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + RIDGE) + (ga - gs) ** 2 / (ha - hs + RIDGE) - ga**2 / (ha + RIDGE)
                gain[(hs < 1) | (ha - hs < 1)] = -1
                k = gain.argmax(1)
                top = gain[np.arange(width), k]
                better = top > best
                best[better] = top[better]
                feature[first : first + width][better] = j
                split[first : first + width][better] = k[better]
            node = 2 * node + 1 + (binned[np.arange(len(y)), feature[node]] > split[node])
        at = node - (1 << depth) + 1
        leaf = RATE * np.bincount(at, g, 1 << depth) / (np.bincount(at, h, 1 << depth) + RIDGE)
        total += leaf[at]
        out_f.append(feature)
        out_s.append(split)
        out_l.append(leaf)
    return Trees(edges, np.array(out_f), np.array(out_s), np.array(out_l), start)


def fold(column: str = "doc_id", of: int = 5):
    """crc32 of the id as text, modulo ``of``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % of


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the statistics of each whole text (null: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in chunks(column_bytes(batch.column("text"))):
                x = features(part)
                arr = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(part)), arr], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(runtime.trimmed(run), "doc_id long, x array<double>")


def score_documents(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, cut: float = 0.3) -> DataFrame:
    """Score every document; ``labels(doc_id, quality)`` outside fold 0 of 5 teach the model.

    Several labels of one document count as one (the largest); null labels
    don't count. The fit takes at most ``train_rows`` labelled rows. Null text is
    empty and is scored like any other; rows with one ``doc_id`` are scored each
    by its own text, and each of them learns from the id's label. Very long texts
    are measured whole. Without labels every score is 0.5; without documents
    there are no rows. Further columns are not looked at.
    """
    spark = docs.sparkSession
    table = runtime.stored(spark, measured(docs), "measured")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").filter(F.col("quality").isNotNull() & (fold() != 0)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = table.join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows).select("x", "quality").toArrow()
    x = np.array(rows.column("x").to_pylist(), np.float64).reshape(len(rows), -1) if len(rows) else np.empty((0, len(features([b""])[0])))
    model = fit(x, rows.column("quality").to_numpy().astype(np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column("x")
            s = model.score(col.flatten().to_numpy().reshape(len(batch), -1)) if len(batch) else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= cut).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return table.withColumn("held_out", fold() == 0).mapInArrow(runtime.trimmed(run), "doc_id long, held_out boolean, score double, predicted int")
