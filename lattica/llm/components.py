"""Connected components of a link table, without gathering links on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``links(a, b)`` to ``(node, root)``, root being the smallest node reachable.

    Each round takes the smallest label among neighbours (a grouped minimum,
    combined before the shuffle) and then jumps to the label's own label, so
    the rounds needed grow with the logarithm of a chain's length. Every round
    is stored, and the driver learns only whether a label changed.
    """
    spark = links.sparkSession
    count = links.count()
    # a task for each half million links, so that few links don't become many small files
    parts = max(spark.sparkContext.defaultParallelism, count // 500_000)
    keep = lambda df, tag: runtime.stored(spark, df.coalesce(parts), tag)
    both = keep(links.select("a", "b").union(links.select("b", "a")).filter("a != b").distinct(), "links")
    labels = keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    for _ in range(rounds):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = labels.join(near, "node").select("node", "root", F.least("root", "near").alias("new"))
        of = labels.select(F.col("node").alias("new"), F.col("root").alias("jump"))
        done = keep(step.join(of, "new", "left").select("node", F.col("root").alias("old"), F.least("new", F.coalesce("jump", "new")).alias("root")), "labels")
        labels = done.select("node", "root")
        if done.filter("old != root").isEmpty():
            return labels
    raise RuntimeError(f"labels still change after {rounds} rounds")


def extended(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """Roots after further links: only the components that the new links join are worked on."""
    if roots is None:
        return components(links)
    spark = links.sparkSession
    for end in ("a", "b"):
        links = links.join(roots.select(F.col("node").alias(end), F.col("root").alias("_root")), end, "left").withColumn(end, F.coalesce("_root", end)).drop("_root")
    merged = components(runtime.stored(spark, links.filter("a != b").distinct(), "root-links")).select(F.col("node").alias("root"), F.col("root").alias("_new"))
    known = roots.join(merged, "root", "left").select("node", F.coalesce("_new", "root").alias("root"))
    fresh = merged.select(F.col("root").alias("node"), F.col("_new").alias("root")).join(roots.select("node"), "node", "left_anti")
    parts = max(spark.sparkContext.defaultParallelism, roots.count() // 500_000)
    return runtime.stored(spark, known.unionByName(fresh).coalesce(parts), "labels")
