"""Dual structure, geometric topology over sets, oriented boxes, mesh generators beyond boxes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import model
from ..functions import numbering
from ..model import Mesh
from . import adjacency, measures
from .fixpoint import store


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, root)`` of ``edges(src, dst)``: the smallest node reachable, by grouped minima and label jumps."""
    spark = edges.sparkSession
    both = store(spark, edges.select("src", "dst").union(edges.select("dst", "src")).distinct())
    labels = store(spark, both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("root")))
    for _ in range(rounds):
        near = both.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("root").alias("near"))
        step = labels.join(near, "node").select("node", "root", F.least("root", "near").alias("new"))
        of = labels.select(F.col("node").alias("new"), F.col("root").alias("jump"))
        done = store(spark, step.join(of, "new", "left").select("node", F.col("root").alias("old"), F.least("new", F.coalesce("jump", "new")).alias("root")))
        labels = done.select("node", "root")
        if done.filter("old != root").isEmpty():
            return labels
    raise RuntimeError("labels still change")


def dual_vertices(mesh: Mesh, dim: int) -> DataFrame:
    """A dual vertex in the middle of each element: ``(handle, x, y, z)``."""
    return measures.centroids(mesh, dim)


def dual_edges(mesh: Mesh, dim: int) -> DataFrame:
    """``(a, b)``, a < b: elements that share a facet."""
    return adjacency.neighbours(mesh, dim).filter("elem < other").select(F.col("elem").alias("a"), F.col("other").alias("b"))


def dual_hyperplanes(mesh: Mesh, dim: int) -> DataFrame:
    """``(key, sheet)``: primal edges by the dual hyperplane that crosses them.

    Edges opposite in a quadrilateral belong to one hyperplane, which is named
    by its smallest edge.
    """
    quads = adjacency.sub_entities(mesh.elements.filter(model.of_dimension(F.col("handle"), dim)), 2).filter(F.size("key") == 4).select("key", "sub_conn").dropDuplicates(["key"])
    ends = lambda i, j: F.array_sort(F.array(F.element_at("sub_conn", i), F.element_at("sub_conn", j)))
    pairs = quads.select(ends(1, 2).alias("p"), ends(3, 4).alias("q")).union(quads.select(ends(2, 3), ends(4, 1)))
    text = lambda c: F.concat_ws(",", F.transform(c, lambda v: F.lpad(v.cast("string"), 20, "0")))
    found = components(pairs.select(text(F.col("p")).alias("src"), text(F.col("q")).alias("dst")))
    return found.select(F.col("node").alias("key"), F.col("root").alias("sheet"))


def senses(mesh: Mesh, groups: DataFrame, dim: int) -> DataFrame:
    """``(key, group, sense)`` of facets between ``groups(group, handle)`` of elements.

    A facet has sense 1 for the group whose element lists it in the order of the
    facet's first element, -1 for the other; facets inside a group have none.
    """
    half = adjacency.facets(mesh, dim).join(groups.withColumnRenamed("handle", "elem"), "elem")
    first = half.groupBy("key").agg(F.min_by("sub_conn", "elem").alias("ref"), F.countDistinct("group").alias("groups"), F.count("*").alias("n"))
    met = half.join(first, "key").filter((F.col("groups") > 1) | (F.col("n") == 1))
    same = F.col("sub_conn") == F.col("ref") if dim == 2 else numbering.match(F.col("ref"), F.col("sub_conn"))["direct"] > 0
    return met.select("key", "group", F.when(same, 1).otherwise(-1).alias("sense"))


def implicit_complement(sense: DataFrame) -> DataFrame:
    """Facets with one sense only: ``(key, sense)``, the sense being that of what lies outside all groups."""
    return sense.groupBy("key").agg(F.count("*").alias("n"), F.first("sense").alias("s")).filter("n = 1").select("key", (-F.col("s")).alias("sense"))


def other_group(sense: DataFrame) -> DataFrame:
    """``(key, group, other)``: the group on a facet's other side."""
    return sense.join(sense.select("key", F.col("group").alias("other")), "key").filter("group != other").select("key", "group", "other")


def principal_axes(points: DataFrame) -> DataFrame:
    """``(group, mx, my, mz, a0x .. a2z)``: mean and principal axes, longest first, of each group of ``points(group, x, y, z)``.

    The moments are sums that combine before the shuffle; only one row a group
    is turned in Python. An axis' largest part is above 0.
    """
    terms = [F.avg(c).alias(f"m{c}") for c in "xyz"] + [F.covar_pop(a, b).alias(f"c{a}{b}") for a, b in ("xx", "yy", "zz", "xy", "xz", "yz")]
    moments = points.groupBy("group").agg(*terms)
    names = [f"a{i}{c}" for i in range(3) for c in "xyz"]
    means = ["mx", "my", "mz"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {n: np.nan_to_num(batch.column(f"c{n}").to_numpy(zero_copy_only=False).astype(float)) for n in ("xx", "yy", "zz", "xy", "xz", "yz")}
            m = np.array([[c["xx"], c["xy"], c["xz"]], [c["xy"], c["yy"], c["yz"]], [c["xz"], c["yz"], c["zz"]]]).transpose(2, 0, 1)
            axes = np.linalg.eigh(m)[1][:, :, ::-1].transpose(0, 2, 1)
            most = np.take_along_axis(axes, np.abs(axes).argmax(2)[:, :, None], 2)
            axes = (axes * np.where(most < 0, -1.0, 1.0)).reshape(-1, 9)
            yield pa.RecordBatch.from_arrays([batch.column("group"), *(batch.column(c) for c in means), *(pa.array(np.ascontiguousarray(axes[:, k])) for k in range(9))], ["group", *means, *names])

    kind = dict(points.dtypes)["group"]
    return moments.mapInArrow(run, f"group {kind}, " + ", ".join(f"{n} double" for n in means + names))


def oriented_boxes(points: DataFrame) -> DataFrame:
    """``(group, cx, cy, cz, l0, l1, l2)``: center and half lengths, longest first, of each group's covariance box of ``points(group, x, y, z)``."""
    names = [f"a{i}{c}" for i in range(3) for c in "xyz"]
    axes = principal_axes(points).drop("mx", "my", "mz")
    placed = points.join(axes, "group")
    dots = placed.select("group", *names, *((F.col(f"a{i}x") * F.col("x") + F.col(f"a{i}y") * F.col("y") + F.col(f"a{i}z") * F.col("z")).alias(f"d{i}") for i in range(3)))
    box = dots.groupBy("group", *names).agg(*(F.min(f"d{i}").alias(f"lo{i}") for i in range(3)), *(F.max(f"d{i}").alias(f"hi{i}") for i in range(3)))
    mid = [(F.col(f"lo{i}") + F.col(f"hi{i}")) / 2 for i in range(3)]
    center = [sum((mid[i] * F.col(f"a{i}{c}") for i in (1, 2)), mid[0] * F.col(f"a0{c}")).alias(f"c{c}") for c in "xyz"]
    half = F.reverse(F.array_sort(F.array(*((F.col(f"hi{i}") - F.col(f"lo{i}")) / 2 for i in range(3)))))
    return box.select("group", *center, *(F.element_at(half, i + 1).alias(f"l{i}") for i in range(3)))


def extrude(mesh: Mesh, layers: int, height: float) -> Mesh:
    """Quads pulled along z into hexahedra, triangles into prisms, layer by layer."""
    top = mesh.vertices.agg(F.max("handle")).first()[0]
    levels = mesh.spark.range(layers + 1).withColumnRenamed("id", "_k")
    v = mesh.vertices.crossJoin(F.broadcast(levels)).select((F.col("handle") + F.col("_k") * top).alias("handle"), "x", "y", (F.col("z") + F.col("_k") * height).alias("z"))  # one row a layer
    etype = F.when(F.col("etype") == model.QUAD, model.HEX).when(F.col("etype") == model.TRI, model.PRISM)
    last = mesh.elements.agg(F.max(model.id_of(F.col("handle")))).first()[0]
    cells = mesh.elements.filter(F.col("etype").isin(model.QUAD, model.TRI)).crossJoin(F.broadcast(levels.filter(F.col("_k") < layers)))
    conn = F.concat(F.transform("conn", lambda c: c + F.col("_k") * top), F.transform("conn", lambda c: c + (F.col("_k") + 1) * top))
    e = cells.select(model.handle(etype, model.id_of(F.col("handle")) + F.col("_k") * last).alias("handle"), etype.alias("etype"), conn.alias("conn"))
    return model.Mesh(v, e)
