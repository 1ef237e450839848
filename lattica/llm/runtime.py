"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see (``spark.checkpoint.dir``).

    It is read from the session. Where it is unset, a temporary folder is made,
    but only for a local master: on a cluster that folder would be private to
    one machine, so a missing setting is an error there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lattica-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(spark: SparkSession, df: DataFrame, tag: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder (with ``options`` of the writer) and reread it.

    The result no longer depends on the shuffle files of any executor, so a
    lost executor costs no recomputation of what came before.
    """
    prepare(spark)
    path = folder(spark, tag)
    df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_folders: list[str] = []


def folder(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder, for ``clear`` to delete."""
    if not _folders:
        atexit.register(clear)
    _folders.append(f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}")
    return _folders[-1]


def clear() -> None:
    """Delete all tables that ``stored`` has written in this session; DataFrames that read them end.

    Called when the driver's Python ends; a long-lived driver may call it after
    it has written its results.
    """
    spark = SparkSession.getActiveSession()
    paths, _folders[:] = _folders[:], []
    if spark is None or spark.sparkContext._jsc is None:
        return
    try:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for p in paths:
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(conf).delete(path, True)
    except Exception:  # noqa: BLE001  the JVM may be gone before the Python side
        return


#: Documents that a Python worker gets at a time.
BATCH_ROWS = 2000


def prepare(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch, so that a batch of long documents fits in a worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def release() -> None:
    """Give freed memory of a Python worker back to the system."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def lean(fn, *args):
    """``fn`` of a grouped table (and ``args``), after which the worker's memory is given back."""

    def run(table):
        out = fn(table, *args)
        del table
        release()
        return out

    return run


def trimmed(run):
    """A batch iterator's function, after whose last batch the worker's memory is given back."""

    def go(batches):
        yield from run(batches)
        release()

    return go


def input_splits(df: DataFrame) -> int:
    """Number of partitions the scan of ``df`` is planned with (runs no job)."""
    return max(1, df.rdd.getNumPartitions())
