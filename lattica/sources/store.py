"""Native store: the relations of a mesh as Parquet, sorted by handle, tags apart."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..model import Mesh, MeshError, Tag
from ..operators import sets as set_ops

_RELATIONS = ("vertices", "elements", "sets", "members", "links", "explicit")


def save(mesh: Mesh, path: str, tags: list[str] | None = None) -> None:
    """Write all relations, and the named tags (all by default).

    Files are range-partitioned by handle, so a filter on a type or dimension
    skips files by their bounds.
    """
    for name in _RELATIONS:
        df = getattr(mesh, name)
        if df is not None:
            key = df.columns[0]
            df.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").parquet(f"{path}/{name}")
    kept = {n: mesh.tag(n) for n in (mesh.tags if tags is None else tags)}
    for n, tag in kept.items():
        tag.values.write.mode("overwrite").parquet(f"{path}/tags/{n}")
    meta = [(n, t.dtype, t.length, t.storage, json.dumps(t.default)) for n, t in kept.items()]
    mesh.spark.createDataFrame(meta, "name string, dtype string, length int, storage string, default string").coalesce(1).write.mode("overwrite").parquet(f"{path}/tag_meta")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def load(spark: SparkSession, path: str) -> Mesh:
    """Read a stored mesh; nothing is scanned before it is asked for."""
    parts = {n: spark.read.parquet(f"{path}/{n}") if _exists(spark, f"{path}/{n}") else None for n in _RELATIONS}
    tags = {r["name"]: Tag(r["name"], r["dtype"], spark.read.parquet(f"{path}/tags/{r['name']}"), json.loads(r["default"]), r["length"], r["storage"]) for r in spark.read.parquet(f"{path}/tag_meta").collect()}
    return Mesh(**parts, tags=tags)


def load_subset(mesh: Mesh, selections: dict[str, list | None], parts: int = 1, part: int = 0) -> Mesh:
    """Sets whose tags have the listed values (None: any), all of them, with what they contain.

    Of the matching sets, ``parts`` contiguous shares are made in handle order,
    and share ``part`` is kept. Contents are taken recursively, elements bring
    their vertices. No match is an error.
    """
    found = mesh.sets.select("handle")
    for name, values in selections.items():
        v = mesh.tag(name).values
        if values is not None:
            v = v.filter(F.col("value").isin(values))
        found = found.join(v.select(F.col("entity").alias("handle")), "handle", "left_semi")
    if parts > 1:
        from ..operators.fields import spread

        found = spread(found, parts).filter(F.col("part") == part).select("handle")
    if found.isEmpty():
        raise MeshError("ENTITY_NOT_FOUND", "no set matches")
    from ..operators.fixpoint import reach

    every = reach(found.withColumnRenamed("handle", "node"), set_ops._containment(mesh)).select(F.col("node").alias("set"))
    members = mesh.members.join(every, "set", "left_semi")
    inside = members.select(F.col("entity").alias("handle")).distinct()
    elements = mesh.elements.join(inside, "handle", "left_semi")
    used = elements.select(F.explode("conn").alias("handle")).unionByName(inside.filter(model.of_type(F.col("handle"), model.VERTEX))).distinct()
    vertices = mesh.vertices.join(used, "handle", "left_semi")
    sets = mesh.sets.join(every.withColumnRenamed("set", "handle"), "handle", "left_semi")
    return mesh.with_(vertices=vertices, elements=elements, sets=sets, members=members)


def tag_values(path: str, spark: SparkSession, name: str) -> DataFrame:
    """Distinct values of a stored tag, from its own files only."""
    return spark.read.parquet(f"{path}/tags/{name}").select("value").distinct()
