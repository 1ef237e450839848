"""Exact removal of long repeated byte strings, by suffix arrays of shards.

A string of ``window`` bytes that occurs twice has the same smallest ``gram``
hash inside, at the same place, in both occurrences (its anchor). Window starts
with the same anchor form runs. Equal windows have equal anchors, so:

* runs are dealt by anchor; a run whose anchor occurs once repeats nothing;
* runs with equal bytes repeat each other wholly, and one stands for all; of the
  equal runs of one batch a single record travels, so copies don't pile up;
* the distinct runs of an anchor go, with their bytes, to one shard. There a
  suffix array is made by induced sorting, and permuted common prefixes of at
  least ``window`` bytes mark the window starts that repeat;
* an anchor with more distinct runs than fill a shard (a passage in very many
  surroundings) has its runs cut into single windows, which are dealt anew by
  their own hashes.

Only the texts that a filter of row ids lets through move to meet their runs or
their marks (``row_filter``); the others stay where they are read.

Every window start belongs to exactly one run, so no string is compared with
itself, and overlapping occurrences in one document count.

Passages of a number of words are found in the same way in texts of which each
word is written as ``CODE`` letters of its hash: a word window has a fixed length
there, whatever the lengths of its words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import row_filter, runtime
from .suffix_array import permuted_prefixes, suffix_array
from .textblocks import U64, Words, chunks, column_bytes, joined, prefix_sums, span_hash

WINDOW, GRAM = 400, 128
#: Letters of a coded word; words of the gram inside a window of words.
CODE, GRAM_WORDS = 4, 24
SEGMENT = 4 << 20
_PLACE = 23
SHARD_BYTES = 3 << 19
RUN = np.dtype([("anchor", "<u8"), ("c1", "<u8"), ("c2", "<u8"), ("doc", "<u4"), ("start", "<u4"), ("count", "<u2"), ("more", "u1")])
ASK = np.dtype([("anchor", "<u8"), ("start", "<u4"), ("count", "<u2")])
MARK = np.dtype([("start", "<u4"), ("count", "<u4")])


def _segments(texts: list[bytes], window: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Texts cut to at most ``SEGMENT`` bytes, overlapping by ``window - 1``; each one's text and place."""
    parts, doc, at = [], [], []
    for i, t in enumerate(texts):
        for a in range(0, max(1, len(t) - window + 1), SEGMENT - window + 1):
            parts.append(t[a : a + SEGMENT] if a or len(t) > SEGMENT else t)
            doc.append(i)
            at.append(a)
    return parts, np.array(doc, np.int64), np.array(at, np.int64)


def runs(texts: list[bytes], window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """The runs of window starts of each text, as records of ``RUN``; ``doc`` numbers the texts."""
    out = [np.empty(0, RUN)]
    parts, doc, place = _segments(texts, window)
    width = window - gram + 1
    for first, part in chunks(parts):
        buf, lo, hi = joined(part)
        n = len(buf) - gram + 1
        if n < width:
            continue
        at = np.arange(n)
        h = span_hash(prefix_sums(buf), at, at + gram)
        key = (h >> U64(_PLACE)) << U64(_PLACE) | at.astype(U64)
        blocks = np.append(key, np.full(-n % width, np.iinfo(np.uint64).max, U64)).reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, 1).ravel()
        back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
        best = np.minimum(back[: n - width + 1], ahead[width - 1 : n])
        anchor = (best & U64((1 << _PLACE) - 1)).astype(np.int64)
        # window starts that stay in their text, numbered by it
        count = np.maximum(hi - lo - window + 1, 0)
        owner = np.repeat(np.arange(len(part)), count)
        starts = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + lo[owner]
        if not len(starts):
            continue
        a = anchor[starts]
        edge = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (owner[1:] != owner[:-1])))
        got = np.empty(len(edge), RUN)
        size = np.diff(np.append(edge, len(starts)))
        begin = starts[edge]
        got["anchor"], got["count"], got["more"] = h[a[edge]], size, 0
        got["doc"] = doc[first + owner[edge]]
        got["start"] = begin - lo[owner[edge]] + place[first + owner[edge]]
        view, digest = memoryview(buf), xxhash.xxh3_128_digest
        whole = b"".join([digest(view[x:y]) for x, y in zip(begin.tolist(), (begin + size + window - 1).tolist())])
        content = np.frombuffer(whole, "<u8").reshape(-1, 2)
        got["c1"], got["c2"] = content[:, 0], content[:, 1]
        out.append(got)
    return np.concatenate(out)


#: Two 64-bit hashes of id and text, which tell rows of one id apart.
_ROW = ("row", "row2")


def _row_key() -> list:
    return [F.xxhash64("text", "doc_id").alias(_ROW[0]), F.xxhash64(F.lit(1), "doc_id", "text").alias(_ROW[1])]


def _row_ids(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([np.asarray(batch.column(c)) for c in _ROW], 1)


_PACKED = "bucket int, runs binary, row_ids binary, marks binary"


def _packed(found: np.ndarray, rows: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Runs dealt by anchor: one record of those with equal bytes, which are marked here where there are several."""
    bucket = (found["anchor"] % U64(buckets)).astype(np.int32)
    order = np.lexsort((found["c2"], found["c1"], found["anchor"], bucket))
    found, rows, bucket = found[order], rows[found["doc"][order]], bucket[order]
    edge = np.flatnonzero(_changes(found, ("anchor", "c1", "c2")))
    times = np.diff(np.append(edge, len(found)))
    several = np.repeat(times > 1, times)
    found["more"] = several
    marks, marked_rows = _mark(found[several]), rows[several]
    found, rows, bucket = found[edge], rows[edge], bucket[edge]
    cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])).tolist() if len(bucket) else []
    to, ends = bucket[cut].tolist(), cut[1:] + [len(bucket)]
    data, ids, none = [found[a:b].tobytes() for a, b in zip(cut, ends)], [rows[a:b].tobytes() for a, b in zip(cut, ends)], [None] * len(cut)
    if len(marks):
        to.append(int(marked_rows[0, 0] % buckets))
        data, ids, none = [*data, None], [*ids, marked_rows.tobytes()], [*none, marks.tobytes()]
    return pa.RecordBatch.from_pydict({"bucket": pa.array(to, pa.int32()), "runs": pa.array(data, pa.binary()), "row_ids": pa.array(ids, pa.binary()), "marks": pa.array(none, pa.binary())})


def _changes(records: np.ndarray, names: tuple[str, ...]) -> np.ndarray:
    out = np.ones(len(records), bool)
    out[1:] = np.logical_or.reduce([records[n][1:] != records[n][:-1] for n in names])
    return out


def _mark(found: np.ndarray) -> np.ndarray:
    out = np.empty(len(found), MARK)
    out["start"], out["count"] = found["start"], found["count"]
    return out


def _texts(batch: pa.RecordBatch, code: bool) -> list[bytes]:
    """The texts of a batch, coded if asked for."""
    texts = column_bytes(batch.column("text"))
    return [c for _, part in chunks(texts) for c in coded(part)] if code else texts


def _dealt(docs: DataFrame, buckets: int, window: int, gram: int, code: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield _packed(runs(_texts(batch, code), window, gram), _row_ids(batch), buckets)

    return docs.mapInArrow(runtime.trimmed(run), _PACKED)


def _by_row(rows: np.ndarray, records: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    order = np.lexsort((rows[:, 1], rows[:, 0]))
    rows, records = rows[order], records[order]
    edge = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]).any(1))) if len(rows) else np.empty(0, np.int64)
    ends = np.append(edge[1:], len(rows)).tolist()
    return rows[edge], [records[a:b].tobytes() for a, b in zip(edge.tolist(), ends)]


_COMPARED = "row long, row2 long, marks binary, asks binary, hot boolean"


def _compared(table: pa.Table, hot: int) -> pa.Table:
    """Of one bucket of runs: those equal to another (marks), and one of each distinct run of a repeated anchor (asks).

    Asks of anchors with more than ``hot`` distinct runs are told apart.
    """
    found = np.concatenate([np.empty(0, RUN), *(np.frombuffer(x, RUN) for x in table.column("runs").to_pylist() if x is not None)])
    ids = [(r is not None, np.frombuffer(x, np.int64).reshape(-1, 2)) for r, x in zip(table.column("runs").to_pylist(), table.column("row_ids").to_pylist())]
    row, known_row = (np.concatenate([np.empty((0, 2), np.int64), *(x for r, x in ids if r == of_runs)]) for of_runs in (True, False))
    known = np.concatenate([np.empty(0, MARK), *(np.frombuffer(x, MARK) for x in table.column("marks").to_pylist() if x is not None)])
    order = np.lexsort((found["c2"], found["c1"], found["anchor"]))
    found, row = found[order], row[order]
    new_anchor = _changes(found, ("anchor",))
    new_content = new_anchor | _changes(found, ("c1", "c2"))
    content = np.cumsum(new_content) - 1
    first = np.flatnonzero(new_content)
    equal = (np.bincount(content, 1 + found["more"]) > 1)[content] & (found["more"] == 0)
    of_anchor = np.cumsum(new_anchor[first]) - 1
    kinds = np.bincount(of_anchor)[of_anchor]
    parts = [(*_by_row(np.concatenate([row[equal], known_row]), np.concatenate([_mark(found[equal]), known])), True, False)]
    for rep, is_hot in ((first[(kinds > 1) & (kinds <= hot)], False), (first[kinds > hot], True)):
        ask = np.empty(len(rep), ASK)
        for name in ASK.names:
            ask[name] = found[name][rep]
        parts.append((*_by_row(row[rep], ask), False, is_hot))
    keys = np.concatenate([p[0] for p in parts])
    marks = [x if m else None for _, data, m, _ in parts for x in data]
    asks = [None if m else x for _, data, m, _ in parts for x in data]
    return pa.table({"row": pa.array(keys[:, 0]), "row2": pa.array(keys[:, 1]), "marks": pa.array(marks, pa.binary()), "asks": pa.array(asks, pa.binary()), "hot": pa.array([h for _, data, _, h in parts for _ in data], pa.bool_())})


def windows(texts: list[bytes], asks: list[np.ndarray], window: int) -> np.ndarray:
    """Each window of the asked runs as a run of its own, whose anchor is its own hash."""
    doc, start, whole = [], [], []
    for i, (text, own) in enumerate(zip(texts, asks)):
        for _, a, count in own.tolist():
            doc += [i] * count
            start += range(a, a + count)
            whole += [xxhash.xxh3_128_digest(text[k : k + window]) for k in range(a, a + count)]
    out = np.zeros(len(start), RUN)
    content = np.frombuffer(b"".join(whole), "<u8").reshape(-1, 2)
    out["doc"], out["start"], out["count"], out["anchor"], out["c1"], out["c2"] = doc, start, 1, content[:, 0], content[:, 0], content[:, 1]
    return out


def _dealt_windows(asked: DataFrame, buckets: int, window: int, code: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                asks = [np.concatenate([np.frombuffer(x, ASK) for x in own]) for own in batch.column("asks").to_pylist()]
                yield _packed(windows(_texts(batch, code), asks, window), _row_ids(batch), buckets)

    return asked.mapInArrow(runtime.trimmed(run), _PACKED)


def _texts_of_runs(table: pa.RecordBatch, shards: int, window: int, code: bool) -> pa.RecordBatch:
    heads: dict[int, list[bytes]] = {}
    bodies: dict[int, list[bytes]] = {}
    for row, text, asks in zip(_row_ids(table).tolist(), _texts(table, code), table.column("asks").to_pylist()):
        for part in asks:
            for anchor, start, count in np.frombuffer(part, ASK).tolist():
                s = anchor % shards
                heads.setdefault(s, []).append(np.array([*row, start, count], np.int64).tobytes())
                bodies.setdefault(s, []).append(text[start : start + count + window - 1])
    keys = list(heads)
    return pa.RecordBatch.from_pydict({"shard": pa.array(keys, pa.int64()), "heads": pa.array([b"".join(heads[k]) for k in keys], pa.binary()), "body": pa.array([b"\xff".join(bodies[k]) for k in keys], pa.binary())})


def repeated_starts(texts: list[bytes], counts: np.ndarray, window: int) -> list[np.ndarray]:
    """For texts of ``count + window - 1`` bytes: which of their first ``count`` places start a repeated window."""
    text = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8)
    order = suffix_array(text)
    before, common = permuted_prefixes(text, order)
    hit = np.flatnonzero(common >= window)
    repeated = np.zeros(len(text), bool)
    repeated[hit] = True
    repeated[before[hit]] = True
    sizes = counts + window
    at = np.cumsum(sizes) - sizes
    return [np.flatnonzero(repeated[a : a + c]) for a, c in zip(at.tolist(), counts.tolist())]


def _shard_marks(table: pa.Table, window: int) -> pa.Table:
    head = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 4) for x in table.column("heads").to_pylist()])
    bodies: list[bytes] = []
    for data in table.column("body").to_pylist():
        bodies += data.split(b"\xff")
    rows, marks = [], []
    for (*row, start, _), hit in zip(head.tolist(), repeated_starts(bodies, head[:, 3], window)):
        if len(hit):
            edge = np.flatnonzero(np.append(True, np.diff(hit) > 1))
            got = np.empty(len(edge), MARK)
            got["start"] = start + hit[edge]
            got["count"] = np.diff(np.append(edge, len(hit)))
            rows.append(row)
            marks.append(got.tobytes())
    return pa.table({"row": pa.array([r[0] for r in rows], pa.int64()), "row2": pa.array([r[1] for r in rows], pa.int64()), "marks": pa.array(marks, pa.binary())})


def _row_marks(rows: DataFrame, buckets: int, window: int, gram: int, code: bool = False) -> DataFrame:
    """The repeated window starts of ``rows(row, row2, text)``, coded if asked for, as packed marks, several records a row."""
    spark = rows.sparkSession
    run_bytes = window + (window - gram) // 2
    compare = lambda df: runtime.stored(spark, df.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(runtime.lean(_compared, SHARD_BYTES // run_bytes), _COMPARED), "runs")
    compared = compare(_dealt(rows, buckets, window, gram, code))
    asked = compared.filter("asks IS NOT NULL")
    volume = {r["hot"]: r["bytes"] for r in asked.groupBy("hot").agg(F.sum(F.length("asks")).alias("bytes")).collect()}
    shards = max(1, volume.get(False, 0) // ASK.itemsize * run_bytes // SHARD_BYTES)

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _texts_of_runs(batch, shards, window, code)

    def texts(hot: bool) -> DataFrame:
        own = asked.filter(F.col("hot") == hot)
        wanted = own.groupBy(*_ROW).agg(F.collect_list("asks").alias("asks"))
        return rows.filter(row_filter.passing(own, _ROW[0])).join(wanted, [*_ROW]).select(*_ROW, "text", "asks")

    carried = texts(False).mapInArrow(runtime.trimmed(carry), "shard long, heads binary, body binary")
    from_shards = runtime.stored(spark, carried.repartition(shards, "shard").groupBy("shard").applyInArrow(runtime.lean(_shard_marks, window), "row long, row2 long, marks binary"), "shard-marks")
    found = compared.filter("marks IS NOT NULL").select(*_ROW, "marks").unionByName(from_shards)
    if volume.get(True):
        found = found.unionByName(compare(_dealt_windows(texts(True), buckets, window, code)).filter("marks IS NOT NULL").select(*_ROW, "marks"))
    return found


def marked(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, words: int = 0) -> DataFrame:
    """``docs`` without its text as a struct ``doc``, its text (null: empty) as ``text``, and packed marks of its repeated window starts.

    Where ``words`` is set, the column ``word_marks`` marks the starts of repeated
    windows of so many words, counted in letters of the coded text.
    """
    runtime.prepare(docs.sparkSession)
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("doc")
    texts = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text"), F.col("doc_id").cast("long").alias("doc_id"), whole)
    keyed = texts.select(*_row_key(), "text", "doc")
    buckets = max(4, runtime.input_splits(docs))
    rows = keyed.select(*_ROW, "text")
    by_row = lambda found, name: found.groupBy(*_ROW).agg(F.collect_list("marks").alias(name))
    found = _row_marks(rows, buckets, window, gram)
    marks, ids = by_row(found, "marks"), found.select(_ROW[0])
    if words:
        more = _row_marks(rows, buckets, words * CODE, min(GRAM_WORDS, -(-words // 2)) * CODE, True)
        marks, ids = marks.join(by_row(more, "word_marks"), [*_ROW], "full"), ids.unionByName(more.select(_ROW[0]))
    has = row_filter.passing(ids, _ROW[0])
    bare = keyed.filter(~has).select("*", *(F.lit(None).cast(t).alias(c) for c, t in marks.dtypes if c not in _ROW))
    return keyed.filter(has).join(marks, [*_ROW], "left").unionByName(bare)


_LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)


def coded(texts: list[bytes]) -> list[bytes]:
    """Each word of a text as ``CODE`` letters."""
    words = Words(texts)
    letters = np.stack([_LETTERS[(words.hash >> U64(6 * k)) & U64(63)] for k in range(CODE)], 1).tobytes()
    cut = (words.first * CODE).tolist()
    return [letters[a:b] for a, b in zip(cut[:-1], cut[1:])]


def spans(marks: list[bytes] | None, window: int) -> np.ndarray:
    """Maximal byte spans (start, end) that marked windows cover."""
    got = np.concatenate([np.frombuffer(m, MARK) for m in marks]) if marks else np.empty(0, MARK)
    if not len(got):
        return np.empty((0, 2), np.int64)
    start = got["start"].astype(np.int64)
    end = start + got["count"] + window - 1
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    edge = np.append(True, start[1:] > end[:-1])
    return np.stack([start[edge], end[np.append(np.flatnonzero(edge)[1:] - 1, len(end) - 1)]], 1)


def word_spans(text: bytes, marks: list[bytes] | None, words: int) -> np.ndarray:
    """Maximal byte spans that marked windows of words cover, from marks of the coded text."""
    got = np.concatenate([np.frombuffer(m, MARK) for m in marks]) if marks else np.empty(0, MARK)
    first = -(-got["start"].astype(np.int64) // CODE)
    last = (got["start"].astype(np.int64) + got["count"] - 1) // CODE
    own = np.flatnonzero(first <= last)  # a start inside a word begins no window of words
    if not len(own):
        return np.empty((0, 2), np.int64)
    place = Words([text])
    return np.stack([place.start[first[own]], place.end[last[own] + words - 1]], 1)


def _united(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Spans of both, those that meet joined."""
    both = np.concatenate([a, b])
    if not len(b):
        return a
    both = both[np.argsort(both[:, 0], kind="stable")]
    end = np.maximum.accumulate(both[:, 1])
    edge = np.append(True, both[1:, 0] > end[:-1])
    return np.stack([both[edge, 0], end[np.append(np.flatnonzero(edge)[1:] - 1, len(end) - 1)]], 1)


def _rest(text: bytes, cut: np.ndarray) -> bytes:
    at = 0
    out = []
    for a, b in cut.tolist():
        out.append(text[at:a])
        at = b
    return b"".join(out) + text[at:]


def report(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per document: bytes, removed bytes, removed spans, and the SHA-256 of what remains.

    Null text is empty. Rows with one ``doc_id`` are documents of their own:
    where their texts are equal they repeat each other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text, marks in zip(batch.column("doc_id").to_pylist(), column_bytes(batch.column("text")), batch.column("marks").to_pylist()):
                cut = spans(marks, window)
                rows.append((key, len(text), int((cut[:, 1] - cut[:, 0]).sum()), len(cut), hashlib.sha256(_rest(text, cut)).hexdigest()))
            cols = list(zip(*rows)) if rows else [[]] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    whole = marked(docs.select(F.col("doc_id").cast("long"), "text"), window, gram).select("doc.doc_id", "text", "marks")
    return whole.mapInArrow(runtime.trimmed(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, words: int = 0) -> DataFrame:
    """``docs`` with the text that remains, and ``n_chars``, if there is one, to match.

    Where ``words`` is set, passages of so many words or more that occur elsewhere
    go, too, however short; case of A-Z and kind of white space don't matter there.
    Bytes of a character that a cut leaves incomplete go, too. Documents of
    which no word remains have nothing left to train on and are dropped.
    """
    schema = docs.schema
    names = [f"c{i}" for i in range(len(schema))]  # columns of docs may be called as those added here

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, marks = column_bytes(batch.column("text")), batch.column("marks").to_pylist()
            more = batch.column("word_marks").to_pylist() if words else [None] * len(texts)
            rest = [_rest(t, _united(spans(m, window), word_spans(t, w, words))).decode("utf-8", "ignore") for t, m, w in zip(texts, marks, more)]
            new = {"text": pa.array(rest, pa.string()), "n_chars": pa.array([len(t) for t in rest], pa.int64())}
            old = {c: batch.column(n) for c, n in zip(schema.names, names) if c != "text"}
            yield pa.RecordBatch.from_arrays([new["text"] if c == "text" else new[c].cast(old[c].type) if c in new else old[c] for c in schema.names], schema.names).filter(pa.array([bool(t.strip()) for t in rest], pa.bool_()))

    whole = marked(docs, window, gram, words)
    columns = [F.col("doc").getField(c).alias(n) for c, n in zip(schema.names, names) if c != "text"]
    return whole.select(*columns, "text", "marks", *["word_marks"] * bool(words)).mapInArrow(runtime.trimmed(run), schema)
