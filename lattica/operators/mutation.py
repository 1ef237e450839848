"""Changes of a mesh: create, delete, merge, reorder, refine, smooth. Each returns a new mesh or relation."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import model
from ..functions import numbering, shapes
from ..model import Mesh, MeshError
from . import adjacency, skinning
from .fixpoint import store
from .ranges import ranked


def create_vertices(mesh: Mesh, points: DataFrame) -> Mesh:
    """Add ``points(ord, x, y, z)``; ids follow the largest there is, in order of ``ord``."""
    last = mesh.vertices.agg(F.coalesce(F.max("handle"), F.lit(0)).alias("last"))
    numbered = ranked(points, ["ord"], "_n").crossJoin(F.broadcast(last))  # one row
    return mesh.with_(vertices=mesh.vertices.unionByName(numbered.select((F.col("last") + F.col("_n") + 1).alias("handle"), "x", "y", "z")))


def create_elements(mesh: Mesh, etype: int, conns: DataFrame) -> Mesh:
    """Add elements ``conns(ord, conn)`` of one type."""
    own = mesh.elements.filter(model.of_type(F.col("handle"), etype))
    last = own.agg(F.coalesce(F.max("handle"), F.lit(etype << model.SHIFT)).alias("last"))
    numbered = ranked(conns, ["ord"], "_n").crossJoin(F.broadcast(last))  # one row
    rows = numbered.select((F.col("last") + F.col("_n") + 1).alias("handle"), F.lit(etype).cast(mesh.elements.schema["etype"].dataType).alias("etype"), "conn")
    return mesh.with_(elements=mesh.elements.unionByName(rows))


def set_coordinates(mesh: Mesh, new: DataFrame) -> Mesh:
    """Overwrite coordinates by ``new(handle, x, y, z)``."""
    kept = mesh.vertices.join(new.select("handle"), "handle", "left_anti").select("handle", "x", "y", "z")
    return mesh.with_(vertices=kept.unionByName(new.select("handle", "x", "y", "z")))


def set_connectivity(mesh: Mesh, new: DataFrame) -> Mesh:
    """Overwrite connectivity by ``new(handle, conn)``."""
    changed = mesh.elements.join(new.withColumnRenamed("conn", "_conn"), "handle", "left")
    return mesh.with_(elements=changed.select("handle", "etype", F.coalesce("_conn", "conn").alias("conn")))


def delete(mesh: Mesh, entities: DataFrame) -> Mesh:
    """Delete entities from all relations; what stands on them stays (sub-entities, elements)."""
    from dataclasses import replace

    gone = entities.select("handle").distinct()

    def without(df: DataFrame | None, *columns: str) -> DataFrame | None:
        if df is None:
            return None
        out = df
        for c in columns:
            out = out.join(gone.withColumnRenamed("handle", c), c, "left_anti")
        return out.select(*df.columns)

    tags = {k: replace(t, values=without(t.values, "entity")) for k, t in mesh.tags.items()}
    return mesh.with_(vertices=without(mesh.vertices, "handle"), elements=without(mesh.elements, "handle"), sets=without(mesh.sets, "handle"), members=without(mesh.members, "set", "entity"), links=without(mesh.links, "parent", "child"), explicit=without(mesh.explicit, "from", "to"), tags=tags)


def remap(mesh: Mesh, pairs: DataFrame) -> Mesh:
    """Put ``pairs(handle, keep)`` into connectivity, sets and explicit links, and drop the replaced entities."""
    inc = mesh.incidence().join(pairs.select(F.col("handle").alias("vertex"), "keep"), "vertex", "left")
    conn = inc.groupBy(F.col("elem").alias("handle")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("keep", "vertex").alias("v")))), lambda s: s["v"]).alias("conn"))
    out = set_connectivity(mesh, conn)
    members = mesh.members
    if members is not None:
        members = members.join(pairs.withColumnRenamed("handle", "entity"), "entity", "left").select("set", "pos", F.coalesce("keep", "entity").alias("entity"))
    gone = pairs.select("handle")
    return out.with_(members=members, vertices=out.vertices.join(gone, "handle", "left_anti"), elements=out.elements.join(gone, "handle", "left_anti"))


def merge_entities(mesh: Mesh, keep: int, remove: int) -> Mesh:
    """Merge two entities of one type; elements must have the same vertices."""
    if keep >> model.SHIFT != remove >> model.SHIFT:
        raise MeshError("TYPE_OUT_OF_RANGE")
    if keep >> model.SHIFT != model.VERTEX:
        keys = mesh.elements.filter(F.col("handle").isin(keep, remove)).select(numbering.key(F.col("conn")).alias("k")).distinct().count()
        if keys != 1:
            raise MeshError("FAILURE", "connectivity differs")
    return remap(mesh, mesh.spark.createDataFrame([(remove, keep)], "handle long, keep long"))


def close_pairs(points: DataFrame, tolerance: float) -> DataFrame:
    """``(a, b)``, a < b, of points ``(handle, x, y, z)`` closer than ``tolerance``: grid cells as wide as that, neighbours looked up."""
    cell = max(tolerance, 1e-300)
    own = points.select("*", *(F.floor(F.col(c) / cell).alias(f"c{c}") for c in "xyz"))
    near = own.select(F.col("handle").alias("b"), *(F.col(c).alias(f"b{c}") for c in "xyz"), *(F.col(f"c{c}").alias(f"d{c}") for c in "xyz"))
    around = own
    for c in "xyz":
        around = around.withColumn(f"d{c}", F.explode(F.array(*(F.col(f"c{c}") + k for k in (-1, 0, 1)))))
    met = around.join(near, ["dx", "dy", "dz"]).filter(F.col("handle") < F.col("b"))
    d2 = sum((F.col(c) - F.col(f"b{c}")) ** 2 for c in "xyz")
    return met.filter(d2 < tolerance * tolerance).select(F.col("handle").alias("a"), "b")


def merge_map(points: DataFrame, tolerance: float) -> DataFrame:
    """``(handle, keep)`` of vertices to merge, keepers taken in handle order.

    A vertex with a smaller keeper within ``tolerance`` goes to the largest such
    keeper; merged vertices keep nothing. Only the smallest handle of a place can
    be a keeper, so rounds go over places, until none changes, and never over
    pairs of vertices that coincide. Keepers are ``tolerance`` apart, so there are
    few around a place.
    """
    spark = points.sparkSession
    finite = points.filter(sum(F.col(c) - F.col(c) for c in "xyz") == 0)  # others are near nothing
    if not tolerance > 0:
        return finite.select("handle", F.col("handle").alias("keep")).limit(0)
    places = store(spark, finite.groupBy("x", "y", "z").agg(F.min("handle").alias("handle")))
    pairs = store(spark, close_pairs(places, tolerance))
    settled = store(spark, places.select("handle").join(pairs.select(F.col("b").alias("handle")), "handle", "left_anti"))  # places known to be keepers
    every = pairs.select(F.col("b").alias("handle")).distinct()
    while True:
        keepers = settled.select(F.col("handle").alias("a"))
        dead = store(spark, pairs.join(keepers, "a", "left_semi").select(F.col("b").alias("handle")).distinct())
        blocked = pairs.join(dead.withColumnRenamed("handle", "a"), "a", "left_anti").join(keepers, "a", "left_anti").select(F.col("b").alias("handle")).distinct()
        new = store(spark, every.join(dead, "handle", "left_anti").join(settled, "handle", "left_anti").join(blocked, "handle", "left_anti"))
        if new.isEmpty():
            break
        settled = settled.unionByName(new)
    keepers = settled.select("handle")
    below, above = (pairs.join(keepers.withColumnRenamed("handle", k), k, "left_semi").select(F.col(p).alias("place"), F.col(k).alias("keep")) for k, p in ("ab", "ba"))
    near = below.unionByName(above).unionByName(keepers.select(F.col("handle").alias("place"), F.col("handle").alias("keep")))
    lists = near.groupBy("place").agg(F.array_sort(F.collect_list("keep")).alias("keepers"))
    known = places.withColumnRenamed("handle", "place").join(lists, "place").select("x", "y", "z", "keepers")
    kept = F.array_max(F.filter("keepers", lambda k: k < F.col("handle")))
    return finite.select("handle", "x", "y", "z").join(known, ["x", "y", "z"]).select("handle", kept.alias("keep")).filter("keep IS NOT NULL")


def merge_vertices(mesh: Mesh, tolerance: float, skin_dim: int | None = None) -> Mesh:
    """Merge vertices within a tolerance: all of them, or those of the skin only."""
    points = mesh.vertices
    if skin_dim is not None:
        points = points.join(skinning.skin_vertices(mesh, skin_dim), "handle", "left_semi")
    return remap(mesh, merge_map(points, tolerance))


def merge_by_tag(mesh: Mesh, values: DataFrame) -> DataFrame:
    """``(handle, keep)``: entities with one integer value ``(entity, value)`` go to the smallest handle."""
    low = values.groupBy("value").agg(F.min("entity").alias("keep"))
    return values.join(low, "value").filter("entity != keep").select(F.col("entity").alias("handle"), "keep")


def merge_elements(mesh: Mesh, dim: int) -> Mesh:
    """Keep one of elements that have the same vertices."""
    twins = adjacency.equivalent(mesh, dim).select("handle", F.col("twin").alias("keep"))
    return remap(mesh, twins)


def add_mid_edge_nodes(mesh: Mesh, dim: int) -> Mesh:
    """Second-order elements: a node in the middle of each edge, shared by all that have the edge."""
    own = mesh.elements.filter(model.of_dimension(F.col("handle"), dim))
    sub = adjacency.sub_entities(own, 1)
    ends = sub.select("key").distinct().select("key", F.element_at("key", 1).alias("a"), F.element_at("key", 2).alias("b"))
    for n in "ab":
        ends = ends.join(mesh.vertices.select(F.col("handle").alias(n), *(F.col(c).alias(f"{n}{c}") for c in "xyz")), n)
    last = mesh.vertices.agg(F.max("handle").alias("last"))
    mids = store(mesh.spark, ranked(ends, ["key"], "_n").crossJoin(F.broadcast(last)).select("key", (F.col("last") + F.col("_n") + 1).alias("handle"), *(((F.col(f"a{c}") + F.col(f"b{c}")) / 2).alias(c) for c in "xyz")))  # one row
    extra = sub.join(mids.select("key", F.col("handle").alias("mid")), "key").groupBy(F.col("elem").alias("handle")).agg(F.transform(F.array_sort(F.collect_list(F.struct("side", "mid"))), lambda s: s["mid"]).alias("extra"))
    elements = mesh.elements.join(extra, "handle", "left").select("handle", "etype", F.when(F.col("extra").isNull(), F.col("conn")).otherwise(F.concat("conn", "extra")).alias("conn"))
    return mesh.with_(vertices=mesh.vertices.unionByName(mids.select("handle", "x", "y", "z")), elements=elements)


def remove_higher_order(mesh: Mesh) -> Mesh:
    """Elements with their corners only; nodes that nothing uses any more go."""
    elements = mesh.elements.withColumn("conn", F.slice("conn", F.lit(1), numbering.corner_count(F.col("etype"), F.col("conn"))))
    used = elements.select(F.explode("conn").alias("handle")).distinct()
    dropped = mesh.incidence().select(F.col("vertex").alias("handle")).distinct().join(used, "handle", "left_anti")
    return mesh.with_(elements=elements, vertices=mesh.vertices.join(dropped, "handle", "left_anti"))


def reorder(values: DataFrame, skip: int | None = None) -> DataFrame:
    """``(handle, new)``: entities ``(entity, value)`` renumbered by value, then handle, within each type.

    Those with the ``skip`` value stay where they are; the others share out the
    handles that they held before.
    """
    free = values if skip is None else values.filter(F.col("value") != skip)
    free = free.select("entity", "value", model.etype_of(F.col("entity")).alias("t"))
    # both lists go type by type and have as many of each, so equal ranks are of one type
    by_value = ranked(free, ["t", "value", "entity"], "n").select(F.col("entity").alias("handle"), "n")
    slots = ranked(free.select("t", "entity"), ["t", "entity"], "n").select(F.col("entity").alias("new"), "n")
    return by_value.join(slots, "n").select("handle", "new")


def split_shared(mesh: Mesh, dim: int, facets: DataFrame) -> Mesh:
    """Cut the mesh open along facets ``(key)``, the sorted vertices of each.

    At every vertex of the cut, elements that no longer meet through facets left
    whole get a vertex of their own; those with the smallest element keep the old one.
    """
    spark = mesh.spark
    cut = store(spark, facets.select("key").distinct())
    touched = store(spark, cut.select(F.explode("key").alias("vertex")).distinct())
    half = adjacency.facets(mesh, dim).select("elem", "key")
    corner = half.join(cut, "key", "left_anti").select("elem", "key", F.explode("key").alias("vertex")).join(touched, "vertex", "left_semi")
    near = store(spark, corner.join(corner.select(F.col("elem").alias("other"), "key", "vertex"), ["key", "vertex"]).filter("elem != other").select("vertex", "elem", "other").distinct())
    own = mesh.elements.filter(model.of_dimension(F.col("handle"), dim))
    label = store(spark, own.select(F.col("handle").alias("elem"), F.explode("conn").alias("vertex")).join(touched, "vertex", "left_semi").withColumn("low", F.col("elem")))
    while True:  # the smallest element on the same side of each vertex; a side has as many elements as the vertex, at most
        low = near.join(label.select("vertex", F.col("elem").alias("other"), F.col("low").alias("o")), ["vertex", "other"]).groupBy("vertex", "elem").agg(F.min("o").alias("o"))
        new = store(spark, label.join(low, ["vertex", "elem"], "left").select("vertex", "elem", F.col("low").alias("old"), F.least("low", F.coalesce("o", "low")).alias("low")))
        if new.filter("old != low").isEmpty():
            break
        label = new.drop("old")
    sides = label.select("vertex", "low").distinct()
    first = sides.groupBy("vertex").agg(F.min("low").alias("first"))
    last = mesh.vertices.agg(F.max("handle")).first()[0]
    fresh = store(spark, ranked(sides.join(first, "vertex").filter("low != first").select("vertex", "low"), ["vertex", "low"], "_n").select("vertex", "low", (F.lit(last) + F.col("_n") + 1).cast("long").alias("twin")))
    swap = label.join(fresh, ["vertex", "low"]).select("elem", "vertex", "twin")
    inc = mesh.incidence().join(swap, ["elem", "vertex"], "left")
    conn = inc.groupBy(F.col("elem").alias("handle")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("twin", "vertex").alias("v")))), lambda x: x["v"]).alias("conn"))
    more = fresh.join(mesh.vertices.withColumnRenamed("handle", "vertex"), "vertex").select(F.col("twin").alias("handle"), "x", "y", "z")
    return set_connectivity(mesh, conn).with_(vertices=mesh.vertices.unionByName(more))


# uniform refinement ------------------------------------------------------------

def _template(etype: int, degree: int) -> tuple[list[dict[int, int]], list[tuple[int, ...]]]:
    """Points of an element cut into ``degree`` parts along each edge, as whole weights of its corners, and its children.

    Simplices are cut along lattice directions (a tetrahedron into the path
    simplices of lattice cubes), others into boxes; children turn as the parent does.
    """
    d, dim = degree, model.DIMENSIONS[etype]
    if etype in (model.EDGE, model.TRI, model.TET):
        # d >= a >= b >= .. >= 0 has the corner weights d - a, a - b, ..
        inside = lambda p: all(x >= y for x, y in zip((d, *p), (*p, 0)))
        spots = [p for p in itertools.product(range(d + 1), repeat=dim) if inside(p)]
        weights = [{k: w for k, w in enumerate(x - y for x, y in zip((d, *p), (*p, 0))) if w} for p in spots]
        number = {p: i for i, p in enumerate(spots)}
        children = []
        for base in spots:
            for axes in itertools.permutations(range(dim)):
                path = [base]
                for axis in axes:
                    path.append(tuple(x + (k == axis) for k, x in enumerate(path[-1])))
                if all(p in number for p in path):
                    odd = sum(axes[i] > axes[j] for i in range(dim) for j in range(i + 1, dim)) % 2
                    children.append(tuple(number[p] for p in ((*path[:-2], path[-1], path[-2]) if odd else path)))
        return weights, children
    ends = [tuple((x + 1) // 2 for x in c) for c in shapes.CORNERS[etype]]
    spots = list(itertools.product(range(d + 1), repeat=dim))
    weights = [{k: w for k, e in enumerate(ends) if (w := math.prod(x if one else d - x for x, one in zip(p, e)))} for p in spots]
    number = {p: i for i, p in enumerate(spots)}
    children = [tuple(number[tuple(x + y for x, y in zip(p, e))] for e in ends) for p in itertools.product(range(d), repeat=dim)]
    return weights, children


def refine(mesh: Mesh, etype: int, degree: int = 2, at: tuple[float, ...] | None = None) -> Mesh:
    """One level of uniform refinement of edges, triangles, quads, tetrahedra or hexahedra.

    New vertices are named by the corners that span them, with reduced weights,
    so neighbours agree on them without any search. ``at`` sets the places, from 0
    to 1 and alike from either end, at which edges of boxes are cut.
    """
    return refined(mesh, etype, degree, at)[0]


def refined(mesh: Mesh, etype: int, degree: int, at: tuple[float, ...] | None = None) -> tuple[Mesh, DataFrame]:
    """As ``refine``, and the nodes ``(elem, all)`` of each element's lattice, the last direction fastest."""
    if etype not in (model.EDGE, model.TRI, model.QUAD, model.TET, model.HEX) or degree < 2:
        raise MeshError("NOT_IMPLEMENTED", f"{model.ETYPES[etype]} by {degree}")
    weights, children = _template(etype, degree)
    spark = mesh.spark
    own = mesh.elements.filter(model.of_type(F.col("handle"), etype))
    if at is not None and (etype in (model.TRI, model.TET) or len(at) != degree + 1):
        raise MeshError("NOT_IMPLEMENTED", "places of cuts")
    shares = [{k: w / sum(own.values()) for k, w in own.items()} for own in weights] if at is None else _shares(etype, at)
    spots = F.array(*(F.array(*(F.struct(F.lit(k + 1).alias("corner"), F.lit(w // math.gcd(*own.values())).alias("w"), F.lit(float(share[k])).alias("f")) for k, w in own.items())) for own, share in zip(weights, shares)))
    named = F.transform(spots, lambda spot: F.array_sort(F.transform(spot, lambda s: F.struct(F.element_at("conn", s["corner"]).alias("v"), s["w"].alias("w"), s["f"].alias("f")))))
    listed = own.select(F.col("handle").alias("elem"), F.posexplode(named).alias("spot", "named"))
    nodes = store(spark, listed.select("elem", "spot", F.transform("named", lambda s: F.struct(s["v"].alias("v"), s["w"].alias("w"))).alias("key"), "named"))
    fresh = nodes.filter(F.size("key") > 1).groupBy("key").agg(F.min("named").alias("named")).withColumn("_size", F.size("key"))
    last = mesh.vertices.agg(F.max("handle")).first()[0]
    new = store(spark, ranked(fresh, ["_size", "key"], "_n").select("key", "named", (F.lit(last) + F.col("_n") + 1).cast("long").alias("handle")))
    parts = new.select("handle", F.explode("named").alias("s")).select("handle", F.col("s.v").alias("v"), F.col("s.f").alias("f"))
    placed = parts.join(mesh.vertices.withColumnRenamed("handle", "v"), "v").groupBy("handle").agg(*(F.sum(F.col(c) * F.col("f")).alias(c) for c in "xyz"))
    known = nodes.join(new.select("key", "handle"), "key", "left").select("elem", "spot", F.coalesce("handle", F.element_at("key", 1)["v"]).alias("node"))
    whole = known.groupBy("elem").agg(F.transform(F.array_sort(F.collect_list(F.struct("spot", "node"))), lambda s: s["node"]).alias("all"))
    kids = F.array(*(F.array(*(F.lit(i + 1) for i in c)) for c in children))
    rows = whole.select("elem", F.posexplode(F.transform(kids, lambda c: F.transform(c, lambda i: F.element_at("all", i)))).alias("k", "conn"))
    out = rows.select(model.handle(etype, (model.id_of(F.col("elem")) - 1) * len(children) + F.col("k") + 1).alias("handle"), F.lit(etype).alias("etype"), "conn")
    return mesh.with_(vertices=mesh.vertices.unionByName(placed.select("handle", "x", "y", "z")), elements=out), whole


def _shares(etype: int, at: tuple[float, ...]) -> list[dict[int, float]]:
    """Shares of the corners at the lattice points of a box cut at some places."""
    ends = [tuple((x + 1) // 2 for x in c) for c in shapes.CORNERS[etype]]
    spots = itertools.product(range(len(at)), repeat=model.DIMENSIONS[etype])
    return [{k: math.prod(at[x] if one else 1 - at[x] for x, one in zip(p, e)) for k, e in enumerate(ends)} for p in spots]


def spectral_fine(mesh: Mesh, etype: int, order: int) -> tuple[Mesh, DataFrame]:
    """Elements cut at the Lobatto nodes of an order, and each coarse element's nodes ``(elem, all)``."""
    at = tuple((shapes.lobatto(order)[0] + 1) / 2)
    return refined(mesh, etype, order, at)


def spectral_coarse(fine: Mesh, nodes: DataFrame, etype: int, order: int) -> Mesh:
    """Back from the nodes ``(elem, all)`` of spectral elements: coarse elements with their corners, and the vertices that they use."""
    ends = [tuple((x + 1) // 2 * order for x in c) for c in shapes.CORNERS[etype]]
    dim = model.DIMENSIONS[etype]
    corner = [sum(x * (order + 1) ** (dim - 1 - d) for d, x in enumerate(e)) for e in ends]
    elements = nodes.select(F.col("elem").alias("handle"), F.lit(etype).alias("etype"), F.array(*(F.element_at("all", i + 1) for i in corner)).alias("conn"))
    used = elements.select(F.explode("conn").alias("handle")).distinct()
    return fine.with_(vertices=fine.vertices.join(used, "handle", "left_semi"), elements=elements)


def refine_where(mesh: Mesh, marked) -> Mesh:
    """Split the triangles' edges that ``marked(ends)`` picks: a condition on ``ax .. bz``, the ends of an edge.

    A triangle is cut by the number of its marked edges into two, three or four;
    neighbours share the new vertices, so the result conforms.
    """
    spark = mesh.spark
    own = mesh.elements.filter(model.of_type(F.col("handle"), model.TRI))
    half = adjacency.sub_entities(own, 1).select("elem", "side", "key")
    ends = half.select("key").distinct().select("key", F.element_at("key", 1).alias("a"), F.element_at("key", 2).alias("b"))
    for n in "ab":
        ends = ends.join(mesh.vertices.select(F.col("handle").alias(n), *(F.col(c).alias(f"{n}{c}") for c in "xyz")), n)
    last = mesh.vertices.agg(F.max("handle")).first()[0]
    mids = store(spark, ranked(ends.filter(marked), ["key"], "_n").select("key", (F.lit(last) + F.col("_n") + 1).cast("long").alias("mid"), *(((F.col(f"a{c}") + F.col(f"b{c}")) / 2).alias(c) for c in "xyz")))
    cut = half.join(mids.select("key", "mid"), "key", "left").groupBy(F.col("elem").alias("handle")).agg(F.transform(F.array_sort(F.collect_list(F.struct("side", "mid"))), lambda s: s["mid"]).alias("m"))
    rows = own.join(cut, "handle")
    v, m = [F.element_at("conn", i + 1) for i in range(3)], [F.element_at("m", i + 1) for i in range(3)]
    there = [x.isNotNull() for x in m]
    turned = lambda c, k: [c[(i + k) % 3] for i in range(3)]
    none = F.array(F.col("conn"))
    kids = none
    for k in range(3):
        (a, b, c), (ab, bc, ca) = turned(v, k), turned(m, k)
        one = F.array(F.array(a, ab, c), F.array(ab, b, c))
        two = F.array(F.array(ab, b, bc), F.array(a, ab, bc), F.array(a, bc, c))
        x, y, z = turned(there, k)
        kids = F.when(x & ~y & ~z, one).when(x & y & ~z, two).otherwise(kids)
    four = F.array(F.array(v[0], m[0], m[2]), F.array(m[0], v[1], m[1]), F.array(m[2], m[1], v[2]), F.array(m[0], m[1], m[2]))
    kids = F.when(there[0] & there[1] & there[2], four).otherwise(kids)
    cells = rows.select("handle", F.posexplode(kids).alias("k", "conn")).select(model.handle(model.TRI, (model.id_of(F.col("handle")) - 1) * 4 + F.col("k") + 1).alias("handle"), F.lit(model.TRI).alias("etype"), "conn")
    rest = mesh.elements.filter(~model.of_type(F.col("handle"), model.TRI)).select("handle", F.col("etype").cast("int").alias("etype"), "conn")
    return mesh.with_(vertices=mesh.vertices.unionByName(mids.select(F.col("mid").alias("handle"), "x", "y", "z")), elements=rest.unionByName(cells))


def hierarchy(mesh: Mesh, etype: int, degrees: list[int]) -> list[Mesh]:
    """The mesh and its refinements, each level made of the one before."""
    out = [mesh]
    for degree in degrees:
        fine = refine(out[-1], etype, degree)
        out.append(fine.with_(vertices=store(mesh.spark, fine.vertices), elements=store(mesh.spark, fine.elements)))
    return out


def parent_of(handle, children: int):
    """Parent's handle of a refined element."""
    return model.handle(model.etype_of(handle), F.floor((model.id_of(handle) - 1) / children) + 1)


# smoothing ---------------------------------------------------------------------

def smooth(mesh: Mesh, dim: int, rounds: int = 1, fixed: DataFrame | None = None, tolerance: float = 0.0, method: str = "lloyd") -> DataFrame:
    """Vertex positions after smoothing, ``(handle, x, y, z)``; vertices of the skin (or ``fixed``) stay.

    ``lloyd`` moves a vertex to the mean of its elements' centroids, ``laplace``
    to the mean of its edge neighbours; all move at once. A round in which no
    vertex moves farther than ``tolerance`` is the last.
    """
    spark = mesh.spark
    still = store(spark, (fixed if fixed is not None else skinning.skin_vertices(mesh, dim)).select("handle"))
    own = mesh.elements.filter(model.of_dimension(F.col("handle"), dim))
    if method == "lloyd":
        inc = store(spark, own.select(F.col("handle").alias("elem"), F.explode("conn").alias("handle")))
    else:
        edge = adjacency.sub_entities(own, 1).select("key").distinct()
        a, b = F.element_at("key", 1), F.element_at("key", 2)
        inc = store(spark, edge.select(a.alias("elem"), b.alias("handle")).union(edge.select(b.alias("elem"), a.alias("handle"))))
    at = mesh.vertices.select("handle", "x", "y", "z")
    for _ in range(rounds):
        if method == "lloyd":
            center = inc.join(at, "handle").groupBy("elem").agg(*(F.avg(c).alias(c) for c in "xyz"))
        else:
            center = at.withColumnRenamed("handle", "elem")
        moved = inc.join(still, "handle", "left_anti").join(center, "elem").groupBy("handle").agg(*(F.avg(c).alias(f"n{c}") for c in "xyz"))
        both = store(spark, at.join(moved, "handle", "left").select("handle", "x", "y", "z", *(F.coalesce(f"n{c}", c).alias(f"n{c}") for c in "xyz")))
        at = both.select("handle", *(F.col(f"n{c}").alias(c) for c in "xyz"))
        if tolerance > 0:
            far = both.agg(F.max(sum((F.col(f"n{c}") - F.col(c)) ** 2 for c in "xyz"))).first()[0]
            if far is None or far <= tolerance * tolerance:
                break
    return at
