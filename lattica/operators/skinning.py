"""Skins and boundaries: facets that belong to one element only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import model
from ..functions import numbering
from ..model import Mesh, MeshError
from . import adjacency, sets
from .fixpoint import MERGED, store


def _trimmed(elements: DataFrame) -> DataFrame:
    """Polygons without the repeated last vertices that pad them."""
    last = F.element_at("conn", -1)
    tail = F.aggregate(F.reverse("conn"), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, v: F.struct((a["n"] + F.when(a["on"] & (v == last), 1).otherwise(0)).alias("n"), (a["on"] & (v == last)).alias("on")))["n"]
    return elements.withColumn("conn", F.when((F.col("etype") == model.POLYGON) & (tail > 1), F.slice("conn", F.lit(1), F.size("conn") - tail + 1)).otherwise(F.col("conn")))


def skin_facets(mesh: Mesh, dim: int, sources: DataFrame | None = None) -> DataFrame:
    """``(elem, side, sub_etype, sub_conn, key)`` of facets used by exactly one element."""
    own = mesh.elements.filter(model.of_dimension(F.col("handle"), dim))
    if sources is not None:
        own = own.join(sources, "handle", "left_semi")
    half = adjacency.sub_entities(_trimmed(own), dim - 1)
    rest = [F.min(F.struct("elem", "side", "sub_etype", "sub_conn")).alias("f")]
    return half.groupBy("key").agg(F.count("*").alias("n"), *rest).filter("n = 1").select("f.elem", "f.side", "f.sub_etype", "f.sub_conn", "key")


def skin_vertices(mesh: Mesh, dim: int, sources: DataFrame | None = None) -> DataFrame:
    """Vertices of the skin."""
    return skin_facets(mesh, dim, sources).select(F.explode("sub_conn").alias("handle")).distinct()


def existing_skin(mesh: Mesh, dim: int) -> DataFrame:
    """Skin facets that exist as entities: ``(handle, reverse)``; reversed ones face into their element."""
    there = mesh.elements.filter(model.of_dimension(F.col("handle"), dim - 1)).select("handle", "conn", numbering.key(F.col("conn")).alias("key"))
    found = skin_facets(mesh, dim).join(there, "key")
    direct = F.when(F.col("sub_conn") == F.col("conn"), 1).otherwise(-1) if dim == 2 else numbering.match(F.col("sub_conn"), F.col("conn"))["direct"]
    return found.select("handle", (direct < 0).alias("reverse"))


def skin_by_dimension(mesh: Mesh, dim: int, target: int) -> DataFrame:
    """Entities of a dimension adjacent to the skin: keys of vertices, each once."""
    found = skin_facets(mesh, dim).select(F.col("key").alias("handle0"), "sub_etype", "sub_conn")
    if target == dim - 1:
        return found.select(F.col("handle0").alias("key"))
    if target == 0:
        return found.select(F.array(F.explode("handle0")).alias("key")).distinct()
    as_elements = found.select(F.monotonically_increasing_id().alias("handle"), F.col("sub_etype").alias("etype"), F.col("sub_conn").alias("conn"))
    return adjacency.sub_entities(as_elements, target, [model.TRI, model.QUAD]).select("key").distinct()


def geometric_skin(mesh: Mesh, dimension_tag: str = "GEOM_DIMENSION") -> DataFrame:
    """Contents of the surface sets (dimension 2) that have exactly one parent."""
    surfaces = mesh.tag(dimension_tag).values.filter("value = 2").select(F.col("entity").alias("child"))
    if surfaces.isEmpty():
        raise MeshError("ENTITY_NOT_FOUND", "no set of dimension 2")
    once = mesh.links.join(surfaces, "child", "left_semi").groupBy("child").agg(F.count("*").alias("n")).filter("n = 1")
    found = None
    inner = mesh.members.filter(model.of_type(F.col("entity"), model.ENTITYSET))
    level = once.select(F.col("child").alias("set"))
    while True:  # recursively, as deep as sets nest
        part = mesh.members.join(level, "set", "left_semi").select(F.col("entity").alias("handle"))
        found = part if found is None else found.unionByName(part)
        level = store(mesh.spark, inner.join(level, "set", "left_semi").select(F.col("entity").alias("set")).distinct())
        if level.isEmpty():
            return found.filter(~model.of_type(F.col("handle"), model.ENTITYSET)).distinct()


def classify_edges(mesh: Mesh, cosine: float = 0.5) -> DataFrame:
    """Edges of a surface: ``(key, kind)``, boundary (one face), non-manifold (over two), inferred (a fold) or other.

    A fold is where the normals of the two faces have a cosine below ``cosine``.
    """
    faces = mesh.elements.filter(model.of_dimension(F.col("handle"), 2))
    corner = lambda i: F.element_at("conn", i)
    p = faces.select(F.col("handle").alias("elem"), corner(1).alias("a"), corner(2).alias("b"), corner(3).alias("c"))
    v = mesh.vertices
    for n in "abc":
        p = p.join(v.select(F.col("handle").alias(n), *(F.col(c).alias(f"{n}{c}") for c in "xyz")), n)
    u = {c: F.col(f"b{c}") - F.col(f"a{c}") for c in "xyz"}
    w = {c: F.col(f"c{c}") - F.col(f"a{c}") for c in "xyz"}
    normal = p.select("elem", (u["y"] * w["z"] - u["z"] * w["y"]).alias("nx"), (u["z"] * w["x"] - u["x"] * w["z"]).alias("ny"), (u["x"] * w["y"] - u["y"] * w["x"]).alias("nz"))
    size = F.sqrt(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2)
    normal = normal.select("elem", *((F.col(c) / size).alias(c) for c in ("nx", "ny", "nz")))
    half = adjacency.sub_entities(faces, 1).select("elem", "key").join(normal, "elem")
    both = half.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("elem", "nx", "ny", "nz")).alias("f"), F.max(F.struct("elem", "nx", "ny", "nz")).alias("g"))
    dot = sum(F.col(f"f.{c}") * F.col(f"g.{c}") for c in ("nx", "ny", "nz"))
    kind = F.when(F.col("n") == 1, "boundary").when(F.col("n") > 2, "nonmanifold").when(dot < cosine, "inferred").otherwise("other")
    return both.select("key", kind.alias("kind"))


def depth(mesh: Mesh, dim: int) -> DataFrame:
    """``(handle, depth)``: 0 for elements touching the skin, then by shared vertices; -1 where unreached."""
    inc = mesh.incidence().join(mesh.elements.filter(model.of_dimension(F.col("handle"), dim)).select(F.col("handle").alias("elem")), "elem", "left_semi").select("elem", "vertex")
    inc = store(mesh.spark, inc)
    front_v = skin_vertices(mesh, dim).withColumnRenamed("handle", "vertex")
    seen, level = None, 0
    while True:
        new = inc.join(front_v, "vertex", "left_semi").select("elem").distinct()
        if seen is not None:
            new = new.join(seen, "elem", "left_anti")
        new = store(mesh.spark, new.withColumn("depth", F.lit(level)))
        if new.isEmpty():
            break
        seen = new if seen is None else seen.unionByName(new)
        if (level + 1) % MERGED == 0:
            seen = store(mesh.spark, seen)
        front_v = inc.join(new.select("elem"), "elem", "left_semi").select("vertex").distinct()
        level += 1
    every = inc.select("elem").distinct()
    if seen is None:
        return every.select(F.col("elem").alias("handle"), F.lit(-1).alias("depth"))
    return every.join(seen, "elem", "left").select(F.col("elem").alias("handle"), F.coalesce("depth", F.lit(-1)).alias("depth"))


def on_boundary(mesh: Mesh, dim: int) -> DataFrame:
    """``(handle, boundary)``: whether each element has a facet of its own."""
    edge = skin_facets(mesh, dim).select(F.col("elem").alias("handle"), F.lit(True).alias("b")).distinct()
    return mesh.elements.filter(model.of_dimension(F.col("handle"), dim)).select("handle").join(edge, "handle", "left").select("handle", F.coalesce("b", F.lit(False)).alias("boundary"))


def set_skin(mesh: Mesh, meshset: int, dim: int) -> DataFrame:
    """Skin of a set's elements."""
    return skin_facets(mesh, dim, sets.contents(mesh, meshset, True).select(F.col("entity").alias("handle")).distinct())
