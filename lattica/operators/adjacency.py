"""Adjacency as joins: up, down and across dimensions, bridges, stars.

Downward adjacency matches sub-entities by their sorted vertices, upward
adjacency counts shared vertices, and both are equi-joins on keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import model
from ..functions import numbering
from ..model import Mesh
from .fixpoint import store
from .ranges import ranked


def sub_entities(elements: DataFrame, dim: int, types: list[int] | None = None) -> DataFrame:
    """``(elem, side, sub_etype, sub_conn, key)``: the canonical sub-entities of each element."""
    sub = numbering.sub_connectivity(F.col("etype"), F.col("conn"), dim, types)
    out = elements.select(F.col("handle").alias("elem"), F.explode(sub).alias("s"))
    return out.select("elem", "s.side", "s.sub_etype", "s.sub_conn", numbering.key(F.col("s.sub_conn")).alias("key"))


def _of_dim(mesh: Mesh, dim: int) -> DataFrame:
    return mesh.elements.filter(model.of_dimension(F.col("handle"), dim))


def downward(mesh: Mesh, sources: DataFrame, dim: int) -> DataFrame:
    """``(source, target)``: existing entities of a lower dimension within each source."""
    own = mesh.elements.join(sources, "handle", "left_semi")
    if dim == 0:
        return own.select(F.col("handle").alias("source"), F.explode("conn").alias("target")).distinct()
    sub = sub_entities(own, dim)
    there = _of_dim(mesh, dim).select(F.col("handle").alias("target"), numbering.key(F.slice("conn", F.lit(1), numbering.corner_count(F.col("etype"), F.col("conn")))).alias("key"))
    return sub.join(there, "key").select(F.col("elem").alias("source"), "target").distinct()


def upward(mesh: Mesh, sources: DataFrame, dim: int) -> DataFrame:
    """``(source, target)``: entities of a higher dimension that have all vertices of each source."""
    above = _of_dim(mesh, dim).select(F.col("handle").alias("target"), F.explode("conn").alias("vertex"))
    points = sources.filter(model.of_type(F.col("handle"), model.VERTEX)).select(F.col("handle").alias("vertex"))
    from_vertices = mesh.dealt(points, "vertex").join(mesh.dealt(above, "vertex"), "vertex").select(F.col("vertex").alias("source"), "target").distinct()
    own = mesh.elements.join(sources, "handle", "left_semi").withColumn("n", F.size(F.array_distinct("conn")))
    inc = own.select(F.col("handle").alias("source"), "n", F.explode(F.array_distinct("conn")).alias("vertex"))
    from_elements = mesh.dealt(inc, "vertex").join(mesh.dealt(above, "vertex").distinct(), "vertex").groupBy("source", "target").agg(F.count("*").alias("met"), F.first("n").alias("n")).filter("met = n").select("source", "target")
    return from_vertices.unionByName(from_elements)  # sources of either are others


def pairs(mesh: Mesh, sources: DataFrame, dim: int) -> DataFrame:
    """``(source, target)`` for all sources of one dimension or several; an entity of ``dim`` is its own target."""
    if dim == 4:
        return owners(mesh, sources)
    same = sources.filter(model.of_dimension(F.col("handle"), dim)).select(F.col("handle").alias("source"), F.col("handle").alias("target")).distinct()
    lower = sources.filter(model.dimension_of(F.col("handle")) < dim)
    higher = sources.filter((model.dimension_of(F.col("handle")) > dim) & (model.dimension_of(F.col("handle")) < 4))
    out = same.unionByName(upward(mesh, lower, dim)).unionByName(downward(mesh, higher, dim))
    if mesh.explicit is None:
        return out  # the three have other sources, each pair once
    found = mesh.explicit.join(sources.withColumnRenamed("handle", "from"), "from").filter(model.of_dimension(F.col("to"), dim))
    return out.unionByName(found.select(F.col("from").alias("source"), F.col("to").alias("target"))).distinct()


def owners(mesh: Mesh, sources: DataFrame) -> DataFrame:
    """Sets that track their members and hold each source."""
    tracking = mesh.sets.filter(F.col("flags").bitwiseAND(F.lit(model.TRACK_OWNER)) != 0).select(F.col("handle").alias("set"))
    held = mesh.members.join(tracking, "set", "left_semi").withColumnRenamed("entity", "handle")
    return held.join(sources, "handle", "left_semi").select(F.col("handle").alias("source"), F.col("set").alias("target")).distinct()


def adjacencies(mesh: Mesh, sources: DataFrame, dim: int, op: str = "union") -> DataFrame:
    """Handles adjacent to any source (union) or to every one (intersect)."""
    found = pairs(mesh, sources, dim)
    if op == "union":
        return found.select(F.col("target").alias("handle")).distinct()
    n = sources.select("handle").distinct().agg(F.count("*").alias("n"))
    met = found.groupBy(F.col("target").alias("handle")).agg(F.countDistinct("source").alias("met"))
    return met.crossJoin(F.broadcast(n)).filter("met = n").select("handle")  # one row


def missing(mesh: Mesh, sources: DataFrame, dim: int) -> DataFrame:
    """Sub-entities that do not exist as entities yet: ``(sub_etype, key, conn)``, each once."""
    sub = sub_entities(mesh.elements.join(sources, "handle", "left_semi"), dim)
    there = _of_dim(mesh, dim).select(numbering.key(F.col("conn")).alias("key"))
    fresh = sub.join(there, "key", "left_anti")
    return fresh.groupBy("sub_etype", "key").agg(F.min_by("sub_conn", F.struct("elem", "side")).alias("conn"))


def create_missing(mesh: Mesh, sources: DataFrame, dim: int) -> Mesh:
    """Materialise them; new ids follow those there are, in order of the sorted vertices."""
    new = missing(mesh, sources, dim)
    last = {r["etype"]: r["last"] for r in mesh.elements.groupBy("etype").agg(F.max(model.id_of(F.col("handle"))).alias("last")).collect()}
    base = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in last.items() for x in kv]), F.col("sub_etype")) if last else F.lit(None).cast("long"), F.lit(0))
    placed = ranked(new, ["sub_etype", "key"], "_n")
    first = placed.groupBy("sub_etype").agg(F.min("_n").alias("_first"))
    placed = placed.join(F.broadcast(first), "sub_etype")  # a row for each type
    rows = placed.select(model.handle(F.col("sub_etype"), base + F.col("_n") - F.col("_first") + 1).alias("handle"), F.col("sub_etype").cast(mesh.elements.schema["etype"].dataType).alias("etype"), "conn")
    return mesh.with_(elements=mesh.elements.unionByName(store(mesh.spark, rows)))


def facets(mesh: Mesh, dim: int) -> DataFrame:
    """Half-facets: ``(elem, side, sub_etype, sub_conn, key)`` of all elements of a dimension, one below it."""
    return sub_entities(_of_dim(mesh, dim), dim - 1)


def neighbours(mesh: Mesh, dim: int, bridge: int | None = None) -> DataFrame:
    """``(elem, other)``: distinct elements of a dimension that share a sub-entity of the bridge dimension."""
    half = sub_entities(_of_dim(mesh, dim), dim - 1 if bridge is None else bridge).select("elem", "key")
    return half.join(half.withColumnRenamed("elem", "other"), "key").filter("elem != other").select("elem", "other").distinct()


def bridge(mesh: Mesh, sources: DataFrame, bridge_dim: int, to_dim: int, layers: int = 1) -> DataFrame:
    """Entities reached through shared sub-entities, layer by layer; sources of the target dimension are included.

    ``to_dim`` -1 means all dimensions from 0 to 3.
    """
    dims = range(4) if to_dim < 0 else (to_dim,)
    front, seen = sources.select("handle").distinct(), None
    for _ in range(layers):
        over = adjacencies(mesh, front, bridge_dim)
        reached = None
        for d in dims:
            part = adjacencies(mesh, over, d)
            reached = part if reached is None else reached.unionByName(part)
        reached = store(mesh.spark, reached.distinct())
        seen_before = seen
        seen = reached if seen is None else seen.unionByName(reached).distinct()
        front = reached if seen_before is None else reached.join(seen_before, "handle", "left_anti")
    return seen


def bridge_of(mesh: Mesh, source: int, bridge_dim: int, to_dim: int) -> DataFrame:
    """One entity's neighbours over a bridge, without itself."""
    one = mesh.spark.createDataFrame([(source,)], "handle long")
    return bridge(mesh, one, bridge_dim, to_dim).filter(F.col("handle") != source)


def manifold(mesh: Mesh, star: DataFrame, dim: int) -> DataFrame:
    """Entities of a dimension adjacent to the star that have at most one neighbour one dimension up."""
    near = adjacencies(mesh, star, dim)
    up = upward(mesh, near, dim + 1).groupBy(F.col("source").alias("handle")).agg(F.count("*").alias("n"))
    return near.join(up, "handle", "left").filter(F.coalesce("n", F.lit(0)) <= 1).select("handle")


def common(mesh: Mesh, one: int, other: int, dim: int) -> DataFrame:
    """Entities of a dimension adjacent to both."""
    return adjacencies(mesh, mesh.spark.createDataFrame([(one,), (other,)], "handle long"), dim, "intersect")


def opposite_vertex(mesh: Mesh, dim: int) -> DataFrame:
    """``(elem, side, vertex)``: in simplices, the vertex that each facet does not have."""
    conn = _of_dim(mesh, dim).filter(F.size("conn") == dim + 1).select(F.col("handle").alias("elem"), "conn")
    return facets(mesh, dim).join(conn, "elem").select("elem", "side", F.element_at(F.array_except("conn", "sub_conn"), 1).alias("vertex"))


def equivalent(mesh: Mesh, dim: int) -> DataFrame:
    """Entities of a dimension with the same vertices as another: ``(handle, twin)``, the twin being the smallest."""
    own = _of_dim(mesh, dim).select("handle", "etype", numbering.key(F.col("conn")).alias("key"))
    low = own.groupBy("etype", "key").agg(F.min("handle").alias("twin"), F.count("*").alias("n")).filter("n > 1")
    return own.join(low, ["etype", "key"]).filter("handle != twin").select("handle", "twin")


def border_vertices(mesh: Mesh, dim: int) -> DataFrame:
    """Vertices of facets that belong to one element only."""
    once = facets(mesh, dim).groupBy("key").agg(F.count("*").alias("n")).filter("n = 1")
    return once.select(F.explode("key").alias("handle")).distinct()


def nonmanifold_facets(mesh: Mesh, dim: int) -> DataFrame:
    """Facets of more than two elements: ``(key, n)``."""
    return facets(mesh, dim).groupBy("key").agg(F.count("*").alias("n")).filter("n > 2")


def side_numbers(mesh: Mesh, dim: int, sub_dim: int) -> DataFrame:
    """``(elem, child, side, sense, offset)`` of existing sub-entities."""
    there = _of_dim(mesh, sub_dim).select(F.col("handle").alias("child"), "conn", numbering.key(F.col("conn")).alias("key"))
    found = sub_entities(_of_dim(mesh, dim), sub_dim).join(there, "key")
    if sub_dim == 1:
        sense = F.when(F.col("sub_conn") == F.col("conn"), 1).otherwise(-1)
        return found.select("elem", "child", "side", sense.alias("sense"), F.lit(0).alias("offset"))
    m = numbering.match(F.col("sub_conn"), F.col("conn"))
    return found.select("elem", "child", "side", m["direct"].alias("sense"), m["offset"].alias("offset"))


def star_ring(mesh: Mesh, center_dim: int = 0) -> DataFrame:
    """For each interior vertex of a surface: its faces in cyclic order, ``(vertex, pos, face)``.

    The ring of a vertex is bounded by the mesh's valence, so each is walked in
    one call. The walk starts at the smallest face.
    """
    import pandas as pd

    edges = sub_entities(_of_dim(mesh, 2), 1).select(F.col("elem").alias("face"), F.element_at("sub_conn", 1).alias("a"), F.element_at("sub_conn", 2).alias("b"))
    # at vertex v, a face has an edge leaving v and one entering it
    leaving = edges.select("face", F.col("a").alias("vertex"), F.col("b").alias("out"))
    entering = edges.select("face", F.col("b").alias("vertex"), F.col("a").alias("back"))
    corners = leaving.join(entering, ["face", "vertex"])

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        by_out = dict(zip(pdf["out"], zip(pdf["face"], pdf["back"])))
        first = pdf["face"].min()
        face, back = first, pdf.loc[pdf["face"] == first, "back"].iloc[0]
        ring = [face]
        while back in by_out and by_out[back][0] != first and len(ring) <= len(pdf):
            face, back = by_out[back]
            ring.append(face)
        return pd.DataFrame({"vertex": pdf["vertex"].iloc[0], "pos": range(len(ring)), "face": ring})

    return corners.groupBy("vertex").applyInPandas(walk, "vertex long, pos int, face long")


def add_explicit(mesh: Mesh, links: DataFrame, both: bool = True) -> Mesh:
    """Add explicit adjacencies ``links(from, to)``, both ways if asked."""
    new = links.select("from", "to")
    if both:
        new = new.unionByName(links.select(F.col("to").alias("from"), F.col("from").alias("to")))
    out = new if mesh.explicit is None else mesh.explicit.unionByName(new)
    return mesh.with_(explicit=out.distinct())


def remove_explicit(mesh: Mesh, links: DataFrame) -> Mesh:
    return mesh.with_(explicit=mesh.explicit.join(links, ["from", "to"], "left_anti"))
