"""What readers and writers share: meshes from arrays, gathered nodes, assigned ids, node orders, parts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..model import Mesh
from ..operators.ranges import ranked


def node_coordinates(spark: SparkSession, x: np.ndarray, y: np.ndarray, z: np.ndarray, start: int = 1) -> DataFrame:
    """Vertices of coordinate arrays, handles from ``start`` on."""
    import pyarrow as pa

    table = pa.table({"handle": np.arange(start, start + len(x)), "x": np.asarray(x, float), "y": np.asarray(y, float), "z": np.asarray(z, float)})
    return spark.createDataFrame(table)


def element_connectivity(spark: SparkSession, etype: int, conn: np.ndarray, start: int = 1, first_node: int = 1) -> DataFrame:
    """Elements of one type of an array of 0-based node numbers, a row each."""
    import pyarrow as pa

    conn = np.asarray(conn, np.int64) + first_node
    handles = (np.int64(etype) << np.int64(model.SHIFT)) | np.arange(start, start + len(conn))
    flat = pa.ListArray.from_arrays(pa.array(np.arange(0, conn.size + 1, conn.shape[1]), pa.int32()), pa.array(conn.ravel()))
    return spark.createDataFrame(pa.table({"handle": handles, "etype": np.full(len(conn), etype, np.int32), "conn": flat}))


def gathered_nodes(mesh: Mesh, elements: DataFrame) -> DataFrame:
    """Vertices that some elements use, with coordinates."""
    used = mesh.elements.join(elements, "handle", "left_semi").select(F.explode("conn").alias("handle")).distinct()
    return mesh.vertices.join(used, "handle", "left_semi")


def assigned_ids(entities: DataFrame, start: int = 1) -> DataFrame:
    """``(handle, id)``: consecutive numbers in order of handles, whatever the types."""
    return ranked(entities.select("handle").distinct(), ["handle"], "_n").select("handle", (F.col("_n") + start).alias("id"))


def numbered_connectivity(mesh: Mesh, ids: DataFrame) -> DataFrame:
    """``(handle, etype, conn)`` with nodes by their assigned ids, as files want them."""
    inc = mesh.incidence().join(ids.select(F.col("handle").alias("vertex"), "id"), "vertex")
    conn = inc.groupBy(F.col("elem").alias("handle")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda s: s["id"]).alias("conn"))
    return mesh.elements.select("handle", "etype").join(conn, "handle")


def reordered(elements: DataFrame, order: tuple[int, ...]) -> DataFrame:
    """Connectivity of which place i holds what stood at ``order[i]``; further nodes stay."""
    head = [F.element_at("conn", i + 1) for i in order]
    return elements.withColumn("conn", F.concat(F.array(*head), F.slice("conn", len(order) + 1, F.greatest(F.size("conn") - len(order), F.lit(0)))))


def explicit_adjacencies(mesh: Mesh, elements: DataFrame, dim: int) -> DataFrame:
    """``(from, to)``: links to entities of a dimension for elements that stand on the same vertices as another."""
    from ..operators import adjacency

    twins = adjacency.equivalent(mesh, dim)
    both = twins.select(F.col("handle").alias("elem")).union(twins.select(F.col("twin").alias("elem"))).distinct()
    found = adjacency.downward(mesh, elements.join(both.withColumnRenamed("elem", "handle"), "handle", "left_semi"), 0)
    return found.select(F.col("source").alias("from"), F.col("target").alias("to"))


def part_of(entities: DataFrame, part: int, parts: int) -> DataFrame:
    """The handles that one of ``parts`` readers takes: contiguous shares, the first ones longer by one."""
    from ..operators.fields import spread

    return spread(entities, parts).filter(F.col("part") == part).select("handle")
