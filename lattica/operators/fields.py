"""Fields on meshes: interpolation, integration, normalisation, reductions over shared copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model
from ..functions.geometry import V, det
from ..model import Mesh, MeshError
from . import measures, spatial


def tet_weights(xi: Column, eta: Column, zeta: Column) -> list[Column]:
    return [1 - xi - eta - zeta, xi, eta, zeta]


def hex_weights(xi: Column, eta: Column, zeta: Column) -> list[Column]:
    signs = [(-1, -1), (1, -1), (1, 1), (-1, 1)]
    return [(1 + xi * a) * (1 + eta * b) * (1 + zeta * c) / 8 for c in (-1, 1) for a, b in signs]


def quad_weights(xi: Column, eta: Column) -> list[Column]:
    return [(1 + xi * a) * (1 + eta * b) / 4 for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1))]


def interpolate(located: DataFrame, mesh: Mesh, etype: int, values: DataFrame, method: str = "linear_fe") -> DataFrame:
    """``(pid, value)`` at located points ``(pid, handle, xi, eta, zeta)``.

    ``constant`` takes the element's own value; ``linear_fe`` sums the shape
    functions over values at vertices ``(entity, value)``.
    """
    if method == "constant":
        return located.join(values.withColumnRenamed("entity", "handle"), "handle").select("pid", "value")
    if method != "linear_fe":
        raise MeshError("NOT_IMPLEMENTED", method)
    weights = {model.TET: tet_weights, model.HEX: hex_weights}[etype](F.col("xi"), F.col("eta"), F.col("zeta"))
    placed = located.join(mesh.elements.select("handle", "conn"), "handle").select("pid", F.posexplode("conn").alias("pos", "entity"), F.array(*weights).alias("w"))
    met = placed.join(values, "entity")
    return met.groupBy("pid").agg(F.sum(F.element_at("w", F.col("pos") + 1) * F.col("value")).alias("value"))


def couple(source: Mesh, target: DataFrame, etype: int, values: DataFrame, method: str = "linear_fe") -> DataFrame:
    """Locate ``target(pid, x, y, z)`` in the source mesh and interpolate there; unlocated points give no row."""
    located = (spatial.locate_in_tets if etype == model.TET else spatial.locate_in_hexes)(target, source)
    return interpolate(located, source, etype, values, method)


def integrals(mesh: Mesh, dim: int, values: DataFrame) -> DataFrame:
    """``(handle, integral)``: element value times measure, for ``values(entity, value)`` on elements."""
    m = measures.measures(mesh, dim)
    return m.join(values.withColumnRenamed("entity", "handle"), "handle").select("handle", (F.col("measure") * F.col("value")).alias("integral"))


def vertex_integrals(mesh: Mesh, etype: int, values: DataFrame) -> DataFrame:
    """``(handle, integral)`` of a field given at vertices: exact for simplices, one point for hexahedra and quads."""
    pts = measures.corner_points(mesh, etype=etype)
    n = model.CORNERS[etype]
    mean = mesh.incidence().withColumnRenamed("elem", "handle").join(values.withColumnRenamed("entity", "vertex"), "vertex").groupBy("handle").agg((F.sum("value") / n).alias("mean"))
    p = [V.at(F.col("points"), i) for i in range(n)]
    if etype == model.HEX:
        from ..functions.quality import _hex_axes

        size = det(*_hex_axes(p)) / 64
    else:
        size = measures.measure_column(F.lit(etype), F.col("points"))
    return pts.select("handle", size.alias("size")).join(mean, "handle").select("handle", (F.col("size") * F.col("mean")).alias("integral"))


def group_integrals(integral: DataFrame, groups: DataFrame) -> DataFrame:
    """``(group, integral)`` over ``groups(group, handle)``."""
    return integral.join(groups, "handle").groupBy("group").agg(F.sum("integral").alias("integral"))


def normalisation(totals: DataFrame, least: float = 1e-8) -> DataFrame:
    """``(group, factor)``: the reciprocal of each integral, 0 where that is next to nothing."""
    return totals.select("group", F.when(F.abs("integral") <= least, F.lit(0.0)).otherwise(1 / F.col("integral")).alias("factor"))


def matching_sets(values: list[DataFrame]) -> DataFrame:
    """Sets grouped by the tuple of their integer tag values: ``(tuple, sets)``, both sorted."""
    rows = None
    for i, v in enumerate(values):
        part = v.select(F.col("entity").alias("set"), F.col("value").alias(f"t{i}"))
        rows = part if rows is None else rows.join(part, "set")
    key = F.concat_ws(",", *(F.col(f"t{i}").cast("string") for i in range(len(values))))
    return rows.groupBy(key.alias("tuple")).agg(F.array_sort(F.collect_list("set")).alias("sets"))


REDUCTIONS = {"min": F.min, "max": F.max, "sum": F.sum, "prod": F.product, "band": F.bit_and, "bor": F.bit_or, "bxor": F.bit_xor}


def reduce_shared(copies: DataFrame, op: str) -> DataFrame:
    """``(gid, value)``: the reduction over all copies ``(gid, part, value)`` of shared entities."""
    if op not in REDUCTIONS:
        raise MeshError("UNSUPPORTED_OPERATION", op)
    return copies.groupBy("gid").agg(REDUCTIONS[op]("value").alias("value"))


def exchange(copies: DataFrame) -> DataFrame:
    """``(gid, part, value)``: every copy gets the value of its owner, the smallest part."""
    owner = copies.groupBy("gid").agg(F.min_by("value", "part").alias("value"))
    return copies.select("gid", "part").join(owner, "gid").select("gid", "part", "value")


def global_ids(entities: DataFrame, start: int = 1) -> DataFrame:
    """``(handle, gid)``: consecutive ids in handle order."""
    from .ranges import index

    return index(entities).select("handle", (F.col("index") + start).alias("gid"))


def spread(values: DataFrame, parts: int) -> DataFrame:
    """Contiguous blocks of handles, ``(part, handle)``; the first ``n % parts`` blocks are one longer."""
    from .ranges import index

    size, more = divmod(values.count(), parts)
    at, long = F.col("index"), more * (size + 1)
    part = F.when(at < long, F.floor(at / (size + 1))).otherwise(more + F.floor((at - long) / max(1, size)))
    return index(values).select(part.alias("part"), "handle")


def locate_points(source: Mesh, etype: int, points: DataFrame, nearest: bool = False) -> DataFrame:
    """``(pid, handle, xi, eta, zeta)`` of points ``(pid, x, y, z)`` in elements of the source.

    With ``nearest``, points in no element get the one whose box is closest (the
    smallest handle among equals), with the coordinates of its middle.
    """
    found = (spatial.locate_in_tets if etype == model.TET else spatial.locate_in_hexes)(points, source)
    if not nearest:
        return found
    left = points.join(found, "pid", "left_anti")
    corner = lambda i: F.struct(*(F.col(f"{c}{i}").alias(c) for c in "xyz"))
    boxes = spatial.bounds(source, 3).select("handle", corner(0).alias("a"), corner(1).alias("b"), corner(0).alias("c"))
    middle = 0.25 if etype == model.TET else 0.0
    close = spatial.closest_triangle(left.select("pid", "x", "y", "z"), boxes).select("pid", "handle", *(F.lit(middle).alias(c) for c in ("xi", "eta", "zeta")))
    return found.unionByName(close)


def locate_entities(source: Mesh, etype: int, target: Mesh, dim: int, nearest: bool = False) -> DataFrame:
    """The source elements that hold a target's vertices (``dim`` 0) or the centroids of its elements; ``pid`` is the target's handle."""
    at = target.vertices.select("handle", "x", "y", "z") if dim == 0 else measures.centroids(target, dim)
    return locate_points(source, etype, at.withColumnRenamed("handle", "pid"), nearest)


class Coupler:
    """Points located in a source mesh once, for as many fields as wanted."""

    def __init__(self, source: Mesh, etype: int, points: DataFrame, nearest: bool = False):
        from .fixpoint import store

        self.source, self.etype = source, etype
        self.located = store(source.spark, locate_points(source, etype, points, nearest))

    def interpolate(self, values: DataFrame, method: str = "linear_fe") -> DataFrame:
        return interpolate(self.located, self.source, self.etype, values, method)
