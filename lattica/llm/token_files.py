"""Token-id files: concatenated ids with Elias-Fano document boundaries.

A file holds consecutive documents in ascending ``doc_id`` order:
magic, number of documents without id, smallest id, id width in bytes, the
Elias-Fano coded boundaries (starts within the file and the end), the
Elias-Fano coded ids (less the smallest), then all token ids.

Every task writes its own files under a fresh name and reports them as rows, so
what counts is the report of the attempt that succeeded; a lost or repeated
attempt leaves a file that no report names.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import elias_fano, runtime, vocab

MAGIC = b"LTKF1\0\0\0"
_HEAD = struct.Struct("<8sQqB")
#: Ids of a file, about: what a reader holds at once.
FILE_IDS = 8_000_000
#: Documents whose places are selected at a time.
READ_DOCS = 4096


def pack_file(doc_ids: list[int | None], ids: list[bytes], width: int) -> bytes:
    """One file of documents, whose ids are given as little-endian 32-bit integers."""
    missing = sum(d is None for d in doc_ids)
    own = np.array(doc_ids[missing:], np.int64)
    base = int(own[0]) if len(own) else 0
    bounds = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])])
    flat = np.frombuffer(b"".join(ids), "<u4")
    if len(flat) and int(flat.max()) >> 8 * width:
        raise ValueError(f"token id {flat.max()} needs more than {width} bytes")
    flat = flat.astype(f"<u{width}")
    return _HEAD.pack(MAGIC, missing, base, width) + elias_fano.encode(bounds) + elias_fano.encode((own - base).astype(np.uint64)) + flat.tobytes()


class TokenFile:
    """An opened file. Places are selected from the coded boundaries; no table of offsets is made.

    ``doc_id(i)``, ``start(i)`` and ``ids(i)`` are of its i-th document.
    """

    def __init__(self, data: bytes):
        magic, missing, base, self.width = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        self.bounds = elias_fano.Reader(data, _HEAD.size)
        self.own, self.missing, self.base = elias_fano.Reader(data, _HEAD.size + self.bounds.size), missing, base
        self.flat = np.frombuffer(data, f"<u{self.width}", offset=_HEAD.size + self.bounds.size + self.own.size)

    def __len__(self) -> int:
        return self.missing + self.own.n

    def doc_id(self, i: int) -> int | None:
        return self.own[i - self.missing] + self.base if i >= self.missing else None

    def start(self, i: int) -> int:
        return self.bounds[i]

    def ids(self, i: int) -> np.ndarray:
        return self.flat[self.bounds[i] : self.bounds[i + 1]]


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


FILES = "path string, first long, docs long, ids long"


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, drops_space: bool, id_width: int = 2) -> DataFrame:
    """Write ``docs(doc_id, text)`` as token files in ascending ``doc_id`` order.

    Null text is empty (only the end id); documents without ``doc_id`` come
    first. Equal ``doc_id`` values, repeated rows among them, keep no order among
    themselves. A very long text stands in one file, whose size it sets; an empty
    table gives no file. An id that does not fit in ``id_width`` bytes is an
    error. Returns the table of files: path, first ``doc_id``, documents and ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = vocab.encoder(tokenizer, drops_space)
        end = np.array([end_id], "<u4").tobytes()
        doc_ids: list[int | None] = []
        ids: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            store, path = _open(folder)
            path = f"{path}/{uuid.uuid4().hex}.tokens"
            with store.open_output_stream(path) as out:
                out.write(pack_file(doc_ids, ids, id_width))
            uri = folder.rstrip("/") + path[path.rindex("/") :]
            row = pa.RecordBatch.from_pydict({"path": [uri], "first": pa.array([doc_ids[0]], pa.int64()), "docs": [len(ids)], "ids": [held]})
            doc_ids.clear()
            ids.clear()
            return row

        for batch in batches:
            texts = batch.column("text").fill_null("").to_pylist()
            keys = batch.column("doc_id").to_pylist()
            for group in vocab.groups(texts):
                for key, got in zip(keys, encoder.encode(group)):
                    doc_ids.append(key)
                    ids.append(got + end)
                    held += len(got) // 4 + 1
                keys = keys[len(group) :]
                if held >= FILE_IDS:
                    yield flush()
                    held = 0
        if doc_ids:
            yield flush()

    _make(folder)
    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return ordered.mapInArrow(runtime.trimmed(run), FILES)


def _make(folder: str) -> None:
    store, path = _open(folder)
    store.create_dir(path, recursive=True)


def read(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Read token files back: one row per document, in the order of the files' first ids.

    ``files`` is a table as ``write`` returns; it has a row for each file, and
    its running sum of ids is made on the driver from those rows.
    """
    listed = sorted(files.collect(), key=lambda r: (r["first"] is not None, r["first"] or 0, r["path"]))
    starts = np.concatenate([[0], np.cumsum([r["ids"] for r in listed])]).tolist()
    rows = [(i, r["path"], s) for i, (r, s) in enumerate(zip(listed, starts))]
    table = spark.createDataFrame(rows, "file int, path string, base long").repartition(max(1, len(rows)), "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                store, inner = _open(path)
                with store.open_input_stream(inner) as f:
                    t = TokenFile(f.read())
                for first in range(0, len(t), READ_DOCS):
                    places = range(first, min(first + READ_DOCS, len(t)))
                    starts = [t.start(i) for i in places] + [t.start(places[-1] + 1)]
                    crc = [zlib.crc32(t.flat[a:b].astype("<u4").tobytes()) for a, b in zip(starts[:-1], starts[1:])]
                    bounds = np.array(starts, np.int64)
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array([t.doc_id(i) for i in places], pa.int64()), "start": pa.array(bounds[:-1] + base), "n_tokens": pa.array(np.diff(bounds)), "ids_crc32": pa.array(crc, pa.int64())})

    return table.mapInArrow(runtime.trimmed(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2, drops_space: bool = True) -> DataFrame:
    """Write the files to the shared folder, then return what reading them gives."""
    spark = docs.sparkSession
    folder = runtime.folder(spark, "tokens")
    return read(spark, runtime.stored(spark, write(docs, folder, tokenizer, end_id, drops_space), "token-files"))
