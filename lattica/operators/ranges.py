"""Algebra of entity lists: single-column DataFrames of handles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import model
from .fixpoint import store


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, "handle", "left_semi").distinct()


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, "handle", "left_anti").distinct()


def unite(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def erase(a: DataFrame, handles: list[int]) -> DataFrame:
    """Without the listed handles."""
    return a.filter(~F.col("handle").isin(handles)) if handles else a


def pop_front(a: DataFrame) -> DataFrame:
    """Without the smallest handle."""
    return a.join(F.broadcast(a.agg(F.min("handle").alias("handle"))), "handle", "left_anti")


def pop_back(a: DataFrame) -> DataFrame:
    """Without the largest handle."""
    return a.join(F.broadcast(a.agg(F.max("handle").alias("handle"))), "handle", "left_anti")


def lower_bound(a: DataFrame, h: int) -> DataFrame:
    """The first handle not below ``h`` (no row if there is none)."""
    return a.filter(F.col("handle") >= h).agg(F.min("handle").alias("handle")).filter("handle IS NOT NULL")


def upper_bound(a: DataFrame, h: int) -> DataFrame:
    """The first handle above ``h`` (no row if there is none)."""
    return a.filter(F.col("handle") > h).agg(F.min("handle").alias("handle")).filter("handle IS NOT NULL")


def by_type(a: DataFrame, etype: int) -> DataFrame:
    return a.filter(model.of_type(F.col("handle"), etype))


def by_dimension(a: DataFrame, dim: int) -> DataFrame:
    return a.filter(model.of_dimension(F.col("handle"), dim))


def counts(a: DataFrame) -> DataFrame:
    """Number of handles of each type and dimension."""
    return a.groupBy(model.etype_of(F.col("handle")).alias("etype"), model.dimension_of(F.col("handle")).alias("dim")).agg(F.count("*").alias("n"))


def all_of_type(a: DataFrame, etype: int) -> DataFrame:
    """One row: whether every handle is of the type."""
    return a.agg(F.coalesce(F.bool_and(model.of_type(F.col("handle"), etype)), F.lit(True)).alias("all_of_type"))


def contains(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether every handle of ``b`` is in ``a``."""
    return b.join(a, "handle", "left_anti").agg((F.count("*") == 0).alias("contains"))


def ranked(df: DataFrame, by: list[str], column: str = "index") -> DataFrame:
    """``df`` with the rank of each row, from 0, in order of some columns; no task sees all rows.

    Rows are dealt into ranges and stored, so that the ranges are the same in
    both uses; the sizes of the ranges (one row each) give every range its first
    rank.
    """
    parted = store(df.sparkSession, df.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()))
    sizes = parted.groupBy("_part").agg(F.count("*").alias("_n"))
    first = sizes.withColumn("_first", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*by)) - 1
    out = parted.withColumn("_own", own).join(F.broadcast(first.select("_part", "_first")), "_part")  # a row for each range
    return out.withColumn(column, (F.col("_own") + F.col("_first")).cast("long")).drop("_part", "_own", "_first")


def _ranked(a: DataFrame, column: str) -> DataFrame:
    return ranked(a.select("handle").distinct(), ["handle"], column)


def index(a: DataFrame) -> DataFrame:
    """``(handle, index)``: the place of each handle in order, from 0."""
    return _ranked(a, "index")


def intervals(a: DataFrame) -> DataFrame:
    """Maximal runs of consecutive handles: ``(first, last, size)``."""
    ranked = _ranked(a, "rank")
    return ranked.groupBy((F.col("handle") - F.col("rank")).alias("island")).agg(F.min("handle").alias("first"), F.max("handle").alias("last"), F.count("*").alias("size")).drop("island")


def compactness(a: DataFrame) -> DataFrame:
    """One row: handles, runs, and handles per run."""
    return intervals(a).agg(F.sum("size").alias("size"), F.count("*").alias("psize")).withColumn("compactness", F.col("size") / F.col("psize"))


def describe(a: DataFrame) -> DataFrame:
    """One row per type: its runs as text."""
    part = F.when(F.col("first") == F.col("last"), model.id_of(F.col("first")).cast("string")).otherwise(F.concat(model.id_of(F.col("first")), F.lit("-"), model.id_of(F.col("last"))))
    return intervals(a).groupBy(model.type_name(model.etype_of(F.col("first"))).alias("type")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", part.alias("s")))), lambda x: x["s"]), ",").alias("runs"))


def interval_lookup(values: DataFrame, spans: DataFrame, cell: int = 1024) -> DataFrame:
    """Values at handles from spans ``(first, last, start)``: ``start + handle - first``.

    Spans are cut into cells of handles, so the join is on equal cells.
    """
    shift = F.lit(cell)
    cut = spans.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("first") / shift), F.floor(F.col("last") / shift))))
    return values.withColumn("_cell", F.floor(F.col("handle") / shift)).join(cut, "_cell").filter("handle BETWEEN first AND last").select("handle", (F.col("start") + F.col("handle") - F.col("first")).alias("value"))
