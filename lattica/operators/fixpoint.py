"""Iteration to a fix point with stored rounds."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Rounds after which what was seen is stored as one, so that no plan reads the files of all rounds.
MERGED = 32


def store(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df``: written to the folder that ``spark.checkpoint.dir`` names and read again."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lattica-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/round-{uuid.uuid4().hex}"
    if not _rounds:
        atexit.register(clear)
    _rounds.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_rounds: list[str] = []


def clear() -> None:
    """Delete all rounds that ``store`` has written in this session; DataFrames that read them end.

    Called when the driver's Python ends; a long-lived driver may call it after
    it has written its results.
    """
    spark = SparkSession.getActiveSession()
    paths, _rounds[:] = _rounds[:], []
    if spark is None or spark.sparkContext._jsc is None:
        return
    try:
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for p in paths:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(conf).delete(path, True)
    except Exception:  # noqa: BLE001  the JVM may be gone before the Python side
        return


def reach(start: DataFrame, edges: DataFrame, hops: int = 0) -> DataFrame:
    """Nodes reached over ``edges(src, dst)`` from ``start(node)``: ``(node, hop)``, start nodes at hop 0.

    Semi-naive: a round joins only the nodes that were new in the one before.
    Cycles end because a node is new once. ``hops`` 0 means as far as it goes.
    """
    spark = start.sparkSession
    from pyspark.sql import functions as F

    edges = store(spark, edges.select("src", "dst"))  # what makes them runs once, not in every round
    seen = store(spark, start.select("node").distinct().withColumn("hop", F.lit(0)))
    front, hop = seen, 0
    while not (hops and hop >= hops):
        hop += 1
        front = store(spark, front.join(edges, front.node == edges.src).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("hop", F.lit(hop)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        if hop % MERGED == 0:
            seen = store(spark, seen)
    return seen
