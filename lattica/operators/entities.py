"""Entity selection: by dimension, type, handle, set membership and tag values."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import model
from ..functions import numbering
from ..model import Mesh, MeshError, Tag
from . import sets


def _within(mesh: Mesh, found: DataFrame, meshset: int | None, recursive: bool) -> DataFrame:
    if meshset is None:
        return found
    own = sets.contents(mesh, meshset, recursive).select(F.col("entity").alias("handle")).distinct()
    return found.join(own, "handle", "left_semi")


def by_dimension(mesh: Mesh, dim: int, meshset: int | None = None, recursive: bool = False) -> DataFrame:
    """Handles of a dimension; above 3 means sets."""
    return _within(mesh, mesh.handles().filter(model.of_dimension(F.col("handle"), dim)), meshset, recursive and dim < 4) if not (recursive and dim > 3) else _nested(mesh, meshset)


def by_type(mesh: Mesh, etype: int, meshset: int | None = None, recursive: bool = False) -> DataFrame:
    """Handles of a type; the nested sets where sets are asked for recursively."""
    if etype == model.ENTITYSET and recursive and meshset is not None:
        return _nested(mesh, meshset)
    return _within(mesh, mesh.handles().filter(model.of_type(F.col("handle"), etype)), meshset, recursive)


def _nested(mesh: Mesh, meshset: int | None) -> DataFrame:
    if meshset is None:
        return mesh.sets.select("handle")
    return sets.nested(mesh, meshset).filter(F.col("handle") != meshset).select("handle")


def by_handle(mesh: Mesh, meshset: int | None = None, recursive: bool = False) -> DataFrame:
    """All entities, or a set's members; recursively without the nested sets themselves."""
    if meshset is None:
        return mesh.handles()
    found = sets.contents(mesh, meshset, recursive).select(F.col("entity").alias("handle"))
    return found.filter(~model.of_type(F.col("handle"), model.ENTITYSET)).distinct() if recursive else found


def _matching(tag: Tag, value: Any, entities: DataFrame) -> DataFrame:
    """Of ``entities``, those with a value of the tag (any, if ``value`` is None).

    A value equal to the tag's default is also matched by entities without one.
    NaN matches nothing.
    """
    values = tag.values.select(F.col("entity").alias("handle"), F.col("value").alias("_value"))
    if value is None:
        return entities.join(values, "handle", "left_semi")
    if isinstance(value, float) and value != value:
        return entities.limit(0)
    same = F.col("_value") == F.lit(value)
    if tag.dtype == "double":
        same &= ~F.isnan("_value")
    if value == tag.default:
        return entities.join(values.filter(~same), "handle", "left_anti")
    return entities.join(values.filter(same), "handle", "left_semi")


def by_type_and_tag(mesh: Mesh, etype: int, tags: list[str], values: list[Any] | None = None, op: str = "intersect", meshset: int | None = None, recursive: bool = False, entities: DataFrame | None = None) -> DataFrame:
    """Handles of a type with tag values, all of them (intersect) or any (union).

    ``entities``, if given, are intersected with the result of an intersection,
    and kept beside that of a union.
    """
    values = values or [None] * len(tags)
    base = by_type(mesh, etype, meshset, recursive)
    if op == "intersect":
        out = base if entities is None else base.join(entities, "handle", "left_semi")
        for name, v in zip(tags, values):
            out = _matching(mesh.tag(name), v, out)
        return out
    if op != "union":
        raise MeshError("UNSUPPORTED_OPERATION", op)
    parts = [_matching(mesh.tag(name), v, base) for name, v in zip(tags, values)]
    out = parts[0] if entities is None else entities.unionByName(parts[0])
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def number(mesh: Mesh, meshset: int | None = None, recursive: bool = False) -> DataFrame:
    """Number of entities by dimension and type. Duplicates in a list-like set count, unless recursive."""
    found = by_handle(mesh, meshset, recursive)
    return found.groupBy(model.dimension_of(F.col("handle")).alias("dim"), model.etype_of(F.col("handle")).alias("etype")).agg(F.count("*").alias("n"))


def decoded(handles: DataFrame) -> DataFrame:
    """Type, id, dimension and type name of each handle."""
    h = F.col("handle")
    return handles.select("handle", model.etype_of(h).alias("etype"), model.id_of(h).alias("id"), model.dimension_of(h).alias("dim"), model.type_name(model.etype_of(h)).alias("type"))


def handle_from_id(mesh: Mesh, etype: int, ident: int) -> DataFrame:
    """The handle of an entity, if it exists."""
    return mesh.handles().filter(F.col("handle") == ((etype << model.SHIFT) | ident))


def coordinates(mesh: Mesh, handles: DataFrame) -> DataFrame:
    """Coordinates of vertices; for other entities the mean over their connectivity, with all its nodes."""
    own = mesh.vertices.join(handles, "handle", "left_semi").select("handle", "x", "y", "z")
    inc = mesh.incidence().join(handles.select(F.col("handle").alias("elem")), "elem", "left_semi")
    mean = inc.join(mesh.vertices.withColumnRenamed("handle", "vertex"), "vertex").groupBy(F.col("elem").alias("handle")).agg(*(F.avg(c).alias(c) for c in "xyz"))
    return own.unionByName(mean)


def connectivity(mesh: Mesh, handles: DataFrame, corners_only: bool = False) -> DataFrame:
    """``(handle, pos, vertex)`` of elements, in order."""
    found = mesh.elements.join(handles, "handle", "left_semi")
    conn = F.slice("conn", F.lit(1), numbering.corner_count(F.col("etype"), F.col("conn"))) if corners_only else F.col("conn")
    return found.select("handle", F.posexplode(conn).alias("pos", "vertex"))


def connectivity_vertices(mesh: Mesh, handles: DataFrame) -> DataFrame:
    """The distinct vertices of elements."""
    return mesh.elements.join(handles, "handle", "left_semi").select(F.explode("conn").alias("handle")).distinct()


def pages(found: DataFrame, size: int) -> DataFrame:
    """Entities in chunks of ``size``, in handle order: ``(chunk, handle)``."""
    from .ranges import index

    return index(found).select(F.floor(F.col("index") / size).alias("chunk"), "handle")


def listing(mesh: Mesh) -> DataFrame:
    """One readable row per element."""
    return mesh.elements.select(F.concat(model.type_name(F.col("etype")), F.lit(" "), model.id_of(F.col("handle"))).alias("entity"), F.concat_ws(",", F.transform("conn", lambda v: model.id_of(v).cast("string"))).alias("vertices"))


def memory_use(mesh: Mesh) -> DataFrame:
    """Estimated bytes by relation: eight for each handle, coordinate and connectivity entry."""
    v = mesh.vertices.agg(F.lit("vertices").alias("relation"), (F.count("*") * 32).alias("bytes"))
    e = mesh.elements.agg(F.lit("elements").alias("relation"), F.coalesce(F.sum(8 + 8 * F.size("conn")), F.lit(0)).cast("long").alias("bytes"))
    return v.unionByName(e)


def dangling(mesh: Mesh) -> DataFrame:
    """Connectivity entries whose vertex does not exist: ``(elem, pos, vertex)``; none in a sound mesh."""
    return mesh.incidence().join(mesh.vertices.select(F.col("handle").alias("vertex")), "vertex", "left_anti").select("elem", "pos", "vertex")


def top(found: DataFrame, by: Column, n: int) -> DataFrame:
    return found.orderBy(by).limit(n)


def ordered_members(mesh: Mesh, meshset: int) -> DataFrame:
    """Members of a set in order, ``(pos, handle)`` counted from 0 without gaps."""
    own = mesh.members.filter(F.col("set") == meshset)
    return own.select((F.row_number().over(Window.partitionBy("set").orderBy("pos")) - 1).cast("long").alias("pos"), F.col("entity").alias("handle"))


def coordinate_blocks(mesh: Mesh, work) -> DataFrame:
    """``work(handles, coords)`` over blocks of vertices as arrays, ``coords`` of three columns; what it returns replaces them."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            handles = batch.column(0).to_numpy(zero_copy_only=False)
            got = work(handles, np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in "xyz"], 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(got[:, k])) for k in range(3))], ["handle", "x", "y", "z"])

    return mesh.vertices.select("handle", "x", "y", "z").mapInArrow(run, "handle long, x double, y double, z double")


def connectivity_blocks(mesh: Mesh, etype: int, work) -> DataFrame:
    """``work(handles, conn)`` over blocks of one type's elements, ``conn`` with a row each; blocks have one length of connectivity."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            handles, conn = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            sizes = np.diff(np.asarray(conn.offsets)) if len(batch) else np.empty(0, np.int64)
            flat, starts = np.asarray(conn.values), np.asarray(conn.offsets)[:-1]
            for n in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == n)
                got = np.ascontiguousarray(work(handles[own], flat[starts[own][:, None] + np.arange(n)]))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, got.size + 1, max(1, got.shape[1])), pa.int32()), pa.array(got.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(handles[own]), lists], ["handle", "conn"])

    own = mesh.elements.filter(model.of_type(F.col("handle"), etype))
    return own.select("handle", "conn").mapInArrow(run, "handle long, conn array<long>")
