"""Tags: create, read with defaults, write, find, propagate."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model
from ..model import Mesh, MeshError, Tag

CREAT, EXCL, ANY, STORE, NOOPQ, DFTOK = "creat", "excl", "any", "store", "noopq", "dftok"


def get_handle(mesh: Mesh, name: str, dtype: str = "long", length: int = 1, storage: str = "sparse", flags: frozenset[str] = frozenset(), default: Any = None) -> tuple[Mesh, Tag]:
    """Find or create a tag, with the model's rules for conflicts."""
    found = mesh.tags.get(name) if name else None
    if found is not None:
        if EXCL in flags:
            raise MeshError("ALREADY_ALLOCATED", name)
        if ANY in flags:
            return mesh, found
        if STORE in flags and found.storage != storage:
            raise MeshError("TYPE_OUT_OF_RANGE", name)
        if found.dtype != dtype and (NOOPQ in flags or "binary" not in (found.dtype, dtype)):
            raise MeshError("TYPE_OUT_OF_RANGE", name)
        if found.length != length:
            raise MeshError("INVALID_SIZE", name)
        if default is not None and default != found.default and DFTOK not in flags and not (storage == "dense" and not default):
            raise MeshError("ALREADY_ALLOCATED", name)
        return mesh, found
    if not flags & {CREAT, EXCL}:
        raise MeshError("TAG_NOT_FOUND", name)
    kind = dtype if length == 1 else f"array<{dtype}>"
    tag = Tag(name, dtype, mesh.spark.createDataFrame([], f"entity long, value {kind}"), default, length, storage)
    return mesh.with_(tags=mesh.tags | {name: tag}), tag


def get_data(mesh: Mesh, name: str, entities: DataFrame) -> DataFrame:
    """``(handle, value)``; entities without a value get the default, and fail at run time if there is none."""
    tag = mesh.tag(name)
    found = entities.join(tag.values.withColumnRenamed("entity", "handle"), "handle", "left")
    if tag.default is not None:
        return found.select("handle", F.coalesce("value", F.lit(tag.default)).alias("value"))
    missing = F.raise_error(F.concat(F.lit(f"TAG_NOT_FOUND: {name} on "), F.col("handle")))
    return found.select("handle", F.when(F.col("value").isNull(), missing.cast(found.schema["value"].dataType)).otherwise(F.col("value")).alias("value"))


def _put(mesh: Mesh, tag: Tag, values: DataFrame) -> Mesh:
    from dataclasses import replace

    return mesh.with_(tags=mesh.tags | {tag.name: replace(tag, values=values)})


def set_data(mesh: Mesh, name: str, values: DataFrame) -> Mesh:
    """Set ``values(entity, value)``, over those there are."""
    tag = mesh.tag(name)
    kept = tag.values.join(values.select("entity"), "entity", "left_anti")
    return _put(mesh, tag, kept.select("entity", "value").unionByName(values.select("entity", "value")))


def clear_data(mesh: Mesh, name: str, entities: DataFrame, value: Any) -> Mesh:
    """One value for all entities."""
    return set_data(mesh, name, entities.select(F.col("handle").alias("entity"), F.lit(value).alias("value")))


def delete_data(mesh: Mesh, name: str, entities: DataFrame) -> Mesh:
    tag = mesh.tag(name)
    return _put(mesh, tag, tag.values.join(entities.select(F.col("handle").alias("entity")), "entity", "left_anti"))


def delete(mesh: Mesh, name: str) -> Mesh:
    mesh.tag(name)
    return mesh.with_(tags={k: v for k, v in mesh.tags.items() if k != name})


def on_entities(mesh: Mesh, entities: DataFrame) -> DataFrame:
    """``(handle, tag)``: the tags set on each entity."""
    out = None
    for name, tag in sorted(mesh.tags.items()):
        own = tag.values.select(F.col("entity").alias("handle")).join(entities, "handle", "left_semi").select("handle", F.lit(name).alias("tag"))
        out = own if out is None else out.unionByName(own)
    return out


def metadata(mesh: Mesh) -> DataFrame:
    """Name, type, length, storage and default (as text) of all tags."""
    rows = [(t.name, t.dtype, t.length, t.storage, None if t.default is None else str(t.default)) for t in mesh.tags.values()]
    return mesh.spark.createDataFrame(rows, "name string, dtype string, length int, storage string, default_value string")


def length_of(tag: Tag) -> int:
    if not tag.length:
        raise MeshError("VARIABLE_DATA_LENGTH", tag.name)
    return tag.length


def tagged(mesh: Mesh, name: str, etype: int | None = None) -> DataFrame:
    """Entities that have a value."""
    found = mesh.tag(name).values.select(F.col("entity").alias("handle")).distinct()
    return found if etype is None else found.filter(model.of_type(F.col("handle"), etype))


def with_value(mesh: Mesh, name: str, value: Any) -> DataFrame:
    """Entities whose own value is equal; NaN equals nothing."""
    tag = mesh.tag(name)
    same: Column = F.col("value") == F.lit(value)
    if tag.dtype == "double":
        same &= ~F.isnan("value")
    return tag.values.filter(same).select(F.col("entity").alias("handle"))


def propagate(mesh: Mesh, name: str, vertices: bool = False) -> DataFrame:
    """A tag's values on sets, given to their members (or to the members' vertices): ``(entity, value)``.

    Where several sets give a value, the largest set handle decides.
    """
    found = mesh.tag(name).values.select(F.col("entity").alias("set"), "value").join(mesh.members, "set")
    if vertices:
        found = found.join(mesh.incidence().withColumnRenamed("elem", "entity"), "entity").select("set", "value", F.col("vertex").alias("entity"))
    return found.groupBy("entity").agg(F.max_by("value", "set").alias("value"))


# How values may be compared.
COMPARISONS = ("==", "!=", "<", "<=", ">", ">=")


def compared(mesh: Mesh, name: str, op: str, value: Any) -> DataFrame:
    """Entities whose own value stands in a relation to another; NaN stands in none."""
    if op not in COMPARISONS:
        raise MeshError("UNSUPPORTED_OPERATION", op)
    tag, v = mesh.tag(name), F.col("value")
    met = {"==": v == value, "!=": v != value, "<": v < value, "<=": v <= value, ">": v > value, ">=": v >= value}[op]
    if tag.dtype == "double":
        met &= ~F.isnan("value")
    return tag.values.filter(met).select(F.col("entity").alias("handle"))


def compared_bytes(mesh: Mesh, name: str, value: bytes) -> DataFrame:
    """Entities whose value has just these bytes."""
    return mesh.tag(name).values.filter(F.col("value").cast("binary") == F.lit(bytearray(value))).select(F.col("entity").alias("handle"))
