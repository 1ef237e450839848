"""Element geometry over relations: corner points, centroids, measures, quality, statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model
from ..functions import quality
from ..functions.geometry import V, det, hex_volume, quad_area, tet_volume, triangle_area
from ..model import Mesh


def corner_points(mesh: Mesh, dim: int | None = None, etype: int | None = None) -> DataFrame:
    """``(handle, etype, points)``: each element's vertices as an array of ``(x, y, z)``, in order."""
    own = mesh.elements
    if etype is not None:
        own = own.filter(model.of_type(F.col("handle"), etype))
    elif dim is not None:
        own = own.filter(model.of_dimension(F.col("handle"), dim))
    inc = own.select("handle", "etype", F.posexplode("conn").alias("pos", "vertex"))
    at = F.struct("pos", F.struct("x", "y", "z").alias("p"))
    placed = inc.join(mesh.vertices.withColumnRenamed("handle", "vertex"), "vertex")
    return placed.groupBy("handle", "etype").agg(F.transform(F.array_sort(F.collect_list(at)), lambda s: s["p"]).alias("points"))


def centroids(mesh: Mesh, dim: int) -> DataFrame:
    """``(handle, x, y, z)``: the mean of each element's vertices."""
    own = mesh.elements.filter(model.of_dimension(F.col("handle"), dim)).select("handle", F.explode("conn").alias("vertex"))
    placed = mesh.dealt(own, "vertex").join(mesh.dealt(mesh.vertices.withColumnRenamed("handle", "vertex"), "vertex"), "vertex")
    return mesh.dealt(placed, "handle").groupBy("handle").agg(*(F.avg(c).alias(c) for c in "xyz"))


def average_position(mesh: Mesh, entities: DataFrame) -> DataFrame:
    """One row: the mean of the distinct vertices of some entities."""
    from .entities import connectivity_vertices

    points = entities.filter(model.of_type(F.col("handle"), model.VERTEX)).unionByName(connectivity_vertices(mesh, entities)).distinct()
    return mesh.vertices.join(points, "handle", "left_semi").agg(*(F.avg(c).alias(c) for c in "xyz"))


def measure_column(etype: Column, points: Column) -> Column:
    """Length, area or volume of an element by its type; null for types without one."""
    p = [V.at(points, i) for i in range(8)]
    fan = F.aggregate(F.sequence(F.lit(2), F.size(points) - 1), F.lit(0.0), lambda s, i: s + triangle_area(p[0], _point(points, i), _point(points, i + 1)))
    cases = {
        model.EDGE: (p[1] - p[0]).length(), model.TRI: triangle_area(*p[:3]), model.QUAD: quad_area(*p[:4]), model.POLYGON: fan,
        model.TET: tet_volume(*p[:4]), model.PYRAMID: tet_volume(p[0], p[1], p[2], p[4]) + tet_volume(p[0], p[2], p[3], p[4]),
        model.PRISM: quality.wedge_volume(p), model.HEX: hex_volume(p),
    }
    out = F.lit(None).cast("double")
    for t, c in cases.items():
        out = F.when(etype == t, c).otherwise(out)
    return out


def _point(points: Column, i: Column) -> V:
    q = F.element_at(points, i.cast("int"))
    return V(q["x"], q["y"], q["z"])


def measures(mesh: Mesh, dim: int) -> DataFrame:
    """``(handle, etype, measure)``."""
    return corner_points(mesh, dim).select("handle", "etype", measure_column(F.col("etype"), F.col("points")).alias("measure"))


def edge_lengths(mesh: Mesh, dim: int) -> DataFrame:
    """``(key, length)`` of the distinct edges of elements."""
    from .adjacency import sub_entities

    sub = sub_entities(mesh.elements.filter(model.of_dimension(F.col("handle"), dim)), 1).select("key").distinct()
    a, b = (mesh.vertices.select(F.col("handle").alias(n), *(F.col(c).alias(f"{n}_{c}") for c in "xyz")) for n in "ab")
    ends = sub.select("key", F.element_at("key", 1).alias("a"), F.element_at("key", 2).alias("b")).join(a, "a").join(b, "b")
    return ends.select("key", (V.of("b_") - V.of("a_")).length().alias("length"))


def size_statistics(mesh: Mesh, dim: int) -> DataFrame:
    """Per type: count, total, minimum, average, rms, maximum (from 0) and standard deviation of the measure."""
    m = F.col("measure")
    found = measures(mesh, dim).groupBy("etype").agg(F.count("*").alias("n"), F.sum(m).alias("total"), F.min(m).alias("minimum"), F.avg(m).alias("average"), F.sqrt(F.avg(m * m)).alias("rms"), F.greatest(F.max(m), F.lit(0.0)).alias("maximum"))
    return found.withColumn("deviation", F.sqrt(F.greatest(F.col("rms") ** 2 - F.col("average") ** 2, F.lit(0.0))))


def quality_of(mesh: Mesh, etype: int, names: list[str], size: float | None = None) -> DataFrame:
    """``(handle, metric...)`` of all elements of a type."""
    ref = None if size is None else F.lit(float(size))
    pts = corner_points(mesh, etype=etype)
    return pts.select("handle", *(quality.measure(etype, n, F.col("points"), model.CORNERS[etype], ref).alias(n) for n in names))


def quality_statistics(mesh: Mesh, etype: int, names: list[str], size: float | None = None) -> DataFrame:
    """One row per metric: count, minimum, maximum."""
    found = quality_of(mesh, etype, names, size)
    long = found.select(F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names))).alias("m")).select("m.*")
    return long.groupBy("metric").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))


def quality_histogram(mesh: Mesh, etype: int, name: str, low: float, high: float, bins: int) -> DataFrame:
    """``(bin, n)`` of a metric; bin 0 and ``bins + 1`` hold what lies outside."""
    found = quality_of(mesh, etype, [name])
    return found.groupBy(F.width_bucket(F.col(name), F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))


def triangles(mesh: Mesh) -> DataFrame:
    """``(handle, a, b, c)`` of all triangles, as point structs."""
    p = corner_points(mesh, etype=model.TRI)
    return p.select("handle", *(F.element_at("points", i + 1).alias(n) for i, n in enumerate("abc")))


def enclosed_volume(tris: DataFrame, sense: str | None = None) -> DataFrame:
    """One row: volume that triangles ``(a, b, c)`` enclose, each counted with its sense."""
    v = det(V.of("a"), V.of("b"), V.of("c")) / 6
    return tris.agg(F.sum(v * F.col(sense) if sense else v).alias("volume"))


def surface_area(tris: DataFrame) -> DataFrame:
    return tris.agg(F.sum(triangle_area(V.of("a"), V.of("b"), V.of("c"))).alias("area"))


def inside_volume(points: DataFrame, tris: DataFrame, sense: str | None = None) -> DataFrame:
    """``(pid, inside)``: whether the solid angles of a closed surface add up to a full turn.

    ``points(pid, p)``. The surface is replicated to the points only if its
    size is within the broadcast limit that Spark checks; otherwise the pairs
    are made by a join on blocks of triangles, and summed.
    """
    from ..functions.geometry import solid_angle

    blocks = 16
    t = tris.withColumn("_block", F.pmod(F.xxhash64("a", "b", "c"), F.lit(blocks)))
    q = points.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    w = solid_angle(V.of("p"), V.of("a"), V.of("b"), V.of("c"))
    turns = q.join(t, "_block").groupBy("pid").agg(F.sum(w * F.col(sense) if sense else w).alias("w"))
    return turns.select("pid", (F.abs("w") > 2 * math.pi).alias("inside"))


def distortion(mesh: Mesh, etype: int, points: int = 2) -> DataFrame:
    """``(handle, distortion)``: the least Jacobian at Gauss points, over the element's mean one; 1 for elements that nothing bends."""
    from collections.abc import Iterator

    import numpy as np
    import pyarrow as pa

    from ..functions import shapes

    shape, (x, w) = shapes.shape(etype), shapes.rule(etype, points)
    n = len(shape.nodes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            flat = batch.column("points").flatten()
            nodes = np.stack([flat.field(c).to_numpy(zero_copy_only=False) for c in "xyz"], 1).reshape(-1, n, 3)
            sizes = np.stack([shapes.size_of(shapes.jacobians(shape, np.broadcast_to(at, (len(batch), len(at))), nodes)) for at in x], 1)
            yield pa.RecordBatch.from_arrays([batch.column("handle"), pa.array(sizes.min(1) * w.sum() / (sizes * w).sum(1))], ["handle", "distortion"])

    return corner_points(mesh, etype=etype).filter(F.size("points") == n).select("handle", "points").mapInArrow(run, "handle long, distortion double")


def fitted_normals(mesh: Mesh, degree: int = 2, rings: int = 1) -> DataFrame:
    """``(handle, x, y, z, mean_curvature)`` of a surface's vertices, by fitting heights over the tangent plane.

    The points of some rings of faces around a vertex are fitted by a polynomial of
    a degree, least squares weighted by closeness; with too few points the degree
    falls. A vertex' neighbourhood is bounded by the mesh's valence.
    """
    import numpy as np
    import pandas as pd

    from .fixpoint import store

    own = mesh.elements.filter(model.of_dimension(F.col("handle"), 2))
    inc = store(mesh.spark, own.select(F.col("handle").alias("elem"), F.explode("conn").alias("vertex")))
    near = inc.join(inc.withColumnRenamed("vertex", "other"), "elem").select("vertex", "other").distinct()
    ring = near
    for _ in range(rings - 1):
        ring = store(mesh.spark, ring.join(near.select(F.col("vertex").alias("other"), F.col("other").alias("next")), "other").select("vertex", F.col("next").alias("other")).distinct())
    pts = corner_points(mesh, 2)
    a, b, c = (V.at(F.col("points"), i) for i in (0, 1, 2))
    up = (b - a).cross(c - a)
    normal = pts.select(F.col("handle").alias("elem"), up.x.alias("nx"), up.y.alias("ny"), up.z.alias("nz")).join(inc, "elem").groupBy("vertex").agg(*(F.sum(f"n{k}").alias(f"n{k}") for k in "xyz"))
    rows = ring.join(mesh.vertices.select(F.col("handle").alias("other"), "x", "y", "z"), "other").join(normal, "vertex")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        vertex = pdf["vertex"].iloc[0]
        p = pdf[["x", "y", "z"]].to_numpy()
        p = p - p[(pdf["other"] == vertex).to_numpy()][0]
        n = pdf[["nx", "ny", "nz"]].iloc[0].to_numpy(float)
        n /= max(np.linalg.norm(n), 1e-300)
        u = np.cross(n, np.eye(3)[np.abs(n).argmin()])
        u /= np.linalg.norm(u)
        v = np.cross(n, u)
        s, t, h = p @ u, p @ v, p @ n
        size = max(np.sqrt((s**2 + t**2).max()), 1e-300)
        d = degree
        while d > 1 and (d + 1) * (d + 2) // 2 - 1 > len(p) - 1:
            d -= 1
        terms = [(i - j, j) for i in range(1, d + 1) for j in range(i + 1)]
        basis = np.stack([(s / size) ** i * (t / size) ** j for i, j in terms], 1)
        weight = 1 / np.sqrt((s**2 + t**2) / size**2 + 0.1)
        coef = np.linalg.lstsq(basis * weight[:, None], h * weight, rcond=None)[0]
        got = {k: c / size ** sum(k) for k, c in zip(terms, coef)}
        hs, ht = got[1, 0], got[0, 1]
        m = n - hs * u - ht * v
        m /= np.linalg.norm(m)
        hss, hst, htt = 2 * got.get((2, 0), 0.0), got.get((1, 1), 0.0), 2 * got.get((0, 2), 0.0)
        mean = ((1 + hs**2) * htt - 2 * hs * ht * hst + (1 + ht**2) * hss) / (2 * (1 + hs**2 + ht**2) ** 1.5)
        return pd.DataFrame({"handle": [vertex], "x": [m[0]], "y": [m[1]], "z": [m[2]], "mean_curvature": [mean]})

    return rows.groupBy("vertex").applyInPandas(fit, "handle long, x double, y double, z double, mean_curvature double")
