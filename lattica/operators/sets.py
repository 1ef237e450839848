"""Entity sets: contents, set algebra, hierarchy by containment and by parent and child links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import model
from ..model import Mesh, MeshError
from .fixpoint import reach


def create(mesh: Mesh, handle: int, flags: int = model.SET_LIKE) -> Mesh:
    """A new, empty set."""
    row = mesh.spark.createDataFrame([(handle, flags)], "handle long, flags int")
    return mesh.with_(sets=row if mesh.sets is None else mesh.sets.unionByName(row))


def set_options(mesh: Mesh, meshset: int, flags: int) -> Mesh:
    """Change a set's flags; a list that becomes set-like loses duplicates and order."""
    changed = mesh.sets.withColumn("flags", F.when(F.col("handle") == meshset, F.lit(flags)).otherwise(F.col("flags")))
    members = mesh.members
    if flags & model.SET_LIKE:
        own = members.filter(F.col("set") == meshset).groupBy("set", "entity").agg(F.min("pos").alias("pos")).select("set", "pos", "entity")
        members = members.filter(F.col("set") != meshset).unionByName(own)
    return mesh.with_(sets=changed, members=members)


def _is_list(mesh: Mesh, meshset: int) -> bool:
    row = mesh.sets.filter(F.col("handle") == meshset).select("flags").first()
    if row is None:
        raise MeshError("ENTITY_NOT_FOUND", str(meshset))
    return bool(row["flags"] & model.ORDERED)


def add(mesh: Mesh, meshset: int, entities: DataFrame) -> Mesh:
    """Add ``entities(handle)``: appended to a list with duplicates kept, or united with a set."""
    own = mesh.members.filter(F.col("set") == meshset)
    last = own.agg(F.coalesce(F.max("pos"), F.lit(-1)).alias("last"))
    new = entities.select(F.lit(meshset).alias("set"), F.col("handle").alias("entity"))
    if not _is_list(mesh, meshset):
        new = new.distinct().join(own.select("entity"), "entity", "left_anti")
    placed = new.crossJoin(F.broadcast(last)).select("set", (F.col("last") + F.row_number().over(Window.partitionBy("set").orderBy("entity"))).cast("long").alias("pos"), "entity")
    return mesh.with_(members=mesh.members.unionByName(placed))


def remove(mesh: Mesh, meshset: int, entities: DataFrame) -> Mesh:
    """Remove members; from a list only the last occurrence of each."""
    gone = entities.select(F.col("handle").alias("entity")).distinct()
    own, rest = mesh.members.filter(F.col("set") == meshset), mesh.members.filter(F.col("set") != meshset)
    if _is_list(mesh, meshset):
        nth = F.row_number().over(Window.partitionBy("set", "entity").orderBy(F.desc("pos")))
        marked = own.withColumn("_nth", nth).join(gone.withColumn("_gone", F.lit(True)), "entity", "left")
        left = marked.filter((F.col("_nth") > 1) | F.col("_gone").isNull()).select("set", "pos", "entity")
    else:
        left = own.join(gone, "entity", "left_anti").select("set", "pos", "entity")
    return mesh.with_(members=rest.unionByName(left))


def clear(mesh: Mesh, meshset: int) -> Mesh:
    return mesh.with_(members=mesh.members.filter(F.col("set") != meshset))


def _combined(mesh: Mesh, one: int, other: int, how: str) -> Mesh:
    own = mesh.members.filter(F.col("set") == one)
    second = mesh.members.filter(F.col("set") == other).select("entity").distinct()
    return mesh.with_(members=mesh.members.filter(F.col("set") != one).unionByName(own.join(second, "entity", how).select("set", "pos", "entity")))


def intersect(mesh: Mesh, one: int, other: int) -> Mesh:
    """The first set keeps what is in both."""
    return _combined(mesh, one, other, "left_semi")


def subtract(mesh: Mesh, one: int, other: int) -> Mesh:
    """The first set loses what is in the other."""
    return _combined(mesh, one, other, "left_anti")


def unite(mesh: Mesh, one: int, other: int) -> Mesh:
    """The first set gains what is in the other."""
    return add(mesh, one, mesh.members.filter(F.col("set") == other).select(F.col("entity").alias("handle")))


def contains(mesh: Mesh, meshset: int, entities: DataFrame, op: str = "intersect") -> DataFrame:
    """One row: whether all (or, with union, any) of the entities are members."""
    own = mesh.members.filter(F.col("set") == meshset).select(F.col("entity").alias("handle"), F.lit(True).alias("_in")).distinct()
    found = entities.join(own, "handle", "left").select(F.coalesce("_in", F.lit(False)).alias("_in"))
    every = F.coalesce(F.bool_and("_in"), F.lit(True)) if op == "intersect" else F.coalesce(F.bool_or("_in"), F.lit(False))
    return found.agg(every.alias("contains"))


def replace(mesh: Mesh, meshset: int, pairs: DataFrame) -> Mesh:
    """Put ``pairs(old, new)`` in place of members, each in its slot."""
    own, rest = mesh.members.filter(F.col("set") == meshset), mesh.members.filter(F.col("set") != meshset)
    new = own.join(pairs.withColumnRenamed("old", "entity"), "entity", "left").select("set", "pos", F.coalesce("new", "entity").alias("entity"))
    return mesh.with_(members=rest.unionByName(new))


def _containment(mesh: Mesh) -> DataFrame:
    return mesh.members.filter(model.of_type(F.col("entity"), model.ENTITYSET)).select(F.col("set").alias("src"), F.col("entity").alias("dst"))


def nested(mesh: Mesh, meshset: int, hops: int = 0) -> DataFrame:
    """The set and all sets inside it: ``(handle, hop)``; cycles are met once."""
    start = mesh.spark.createDataFrame([(meshset,)], "node long")
    return reach(start, _containment(mesh), hops).select(F.col("node").alias("handle"), "hop")


def contents(mesh: Mesh, meshset: int, recursive: bool = False) -> DataFrame:
    """Rows of ``members`` of a set, or of it and all sets inside."""
    if not recursive:
        return mesh.members.filter(F.col("set") == meshset)
    return mesh.members.join(nested(mesh, meshset).select(F.col("handle").alias("set")), "set", "left_semi")


def children(mesh: Mesh, meshset: int, hops: int = 1) -> DataFrame:
    """Descendants over child links within ``hops`` (0 or less: all): ``(handle, hop)``."""
    edges = mesh.links.select(F.col("parent").alias("src"), F.col("child").alias("dst"))
    found = reach(mesh.spark.createDataFrame([(meshset,)], "node long"), edges, max(0, hops))
    return found.filter(F.col("node") != meshset).select(F.col("node").alias("handle"), "hop")


def parents(mesh: Mesh, meshset: int, hops: int = 1) -> DataFrame:
    """Ancestors over parent links within ``hops`` (0 or less: all): ``(handle, hop)``."""
    edges = mesh.links.select(F.col("child").alias("src"), F.col("parent").alias("dst"))
    found = reach(mesh.spark.createDataFrame([(meshset,)], "node long"), edges, max(0, hops))
    return found.filter(F.col("node") != meshset).select(F.col("node").alias("handle"), "hop")


def contained(mesh: Mesh, meshset: int, hops: int = 1) -> DataFrame:
    """Sets inside a set within ``hops`` (0 or less: all): ``(handle, hop)``."""
    return nested(mesh, meshset, max(0, hops)).filter(F.col("handle") != meshset)


def link_counts(mesh: Mesh) -> DataFrame:
    """Number of parents, children and directly contained sets of each set."""
    child = mesh.links.groupBy(F.col("parent").alias("handle")).agg(F.count("*").alias("n_child"))
    parent = mesh.links.groupBy(F.col("child").alias("handle")).agg(F.count("*").alias("n_parent"))
    inner = _containment(mesh).groupBy(F.col("src").alias("handle")).agg(F.count("*").alias("n_contained"))
    out = mesh.sets.select("handle")
    for part in (child, parent, inner):
        out = out.join(part, "handle", "left")
    return out.select("handle", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_child", "n_parent", "n_contained")))


def link(mesh: Mesh, parent: int, child: int) -> Mesh:
    """Link a parent and a child, both ends; linked twice counts once."""
    row = mesh.spark.createDataFrame([(parent, child)], "parent long, child long")
    new = row.join(mesh.links, ["parent", "child"], "left_anti").select("parent", "child", F.lit(0).alias("pos"))
    return mesh.with_(links=mesh.links.unionByName(new))


def unlink(mesh: Mesh, parent: int, child: int) -> Mesh:
    return mesh.with_(links=mesh.links.filter(~((F.col("parent") == parent) & (F.col("child") == child))))
