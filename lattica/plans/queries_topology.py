"""Registered queries: adjacency, numbering, skins, structured boxes, refinement and smoothing on generated meshes."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import model
from ..functions import numbering
from ..operators import adjacency as adj
from ..operators import distribution, mutation, skinning
from ..operators.structured import Box, partition
from . import tables as t

QUERIES, ORACLE = {}, {}


def H():
    return F.col("handle")


N = 6
S = t.SUB_SQL


def add(name, run, sql=None):
    QUERIES[name] = lambda s, d: run(s)
    if sql:
        ORACLE[name] = sql


def text(c):
    return F.concat_ws(",", F.transform(c, lambda v: v.cast("string")))


def long(df, *names):
    return df.select(*(F.col(c).cast("long").alias(c) if c in names else F.col(c) for c in df.columns))


HEX, QUAD, TET, TRI = f"WITH {t.hex_sql(N)}", f"WITH {t.quad_sql(8)}", f"WITH {t.tet_sql(3)}", f"WITH {t.tri_sql(8)}"
hexes, quads, tets, tris = lambda s: t.hex_mesh(s, N), lambda s: t.quad_mesh(s, 8), lambda s: t.tet_mesh(s, 3), lambda s: t.tri_mesh(s, 8)


def half(cells, etype, dim):
    """SQL: facets of a table of cells as ``(elem, side, sub_etype, sc, k)``."""
    return f", {S}, hf AS (SELECT handle AS elem, side, sub_etype, list_transform(local, lambda x: conn[x + 1]) AS sc, list_sort(list_transform(local, lambda x: conn[x + 1])) AS k FROM {cells} JOIN sub ON sub.etype = {etype} AND subdim = {dim})"


K = "array_to_string(k, ',') AS key"
# numbering ---------------------------------------------------------------------------
add("c01_table", lambda s: long(numbering.table(s).withColumn("local", text("local")), "etype", "subdim", "side", "sub_etype"), f"WITH {S} SELECT etype::BIGINT AS etype, subdim::BIGINT AS subdim, side::BIGINT AS side, sub_etype::BIGINT AS sub_etype, array_to_string(local, ',') AS local FROM sub")
add("c02_sub_connectivity", lambda s: adj.sub_entities(hexes(s).elements, 1).select("elem", F.col("side").cast("long"), text("sub_conn").alias("conn")), f"{HEX}{half('bh', 9, 1)} SELECT elem, side::BIGINT AS side, array_to_string(sc, ',') AS conn FROM hf")
add("c02_tet_faces", lambda s: adj.sub_entities(tets(s).elements, 2).select("elem", F.col("side").cast("long"), text("sub_conn").alias("conn")), f"{TET}{half('bt', 5, 2)} SELECT elem, side::BIGINT AS side, array_to_string(sc, ',') AS conn FROM hf")
add("c03_adjacent_sides", lambda s: s.createDataFrame([(f, e) for f in range(6) for e in numbering.adjacent_sides(model.HEX, 2, [f], 1, False)], "face long, edge long"), f"WITH {S} SELECT f.side::BIGINT AS face, e.side::BIGINT AS edge FROM sub f JOIN sub e ON f.etype = 9 AND f.subdim = 2 AND e.etype = 9 AND e.subdim = 1 AND list_has_all(f.local, e.local)")
add("c04_side_numbers", lambda s: long(adj.side_numbers(adj.create_missing(tets(s), tets(s).elements.select("handle"), 2), 3, 2), "side", "sense", "offset").groupBy("side", "sense").agg(F.count("*").alias("n")), f"{TET}{half('bt', 5, 2)}, f AS (SELECT k, arg_min(sc, elem * 8 + side) AS c FROM hf GROUP BY k) SELECT side::BIGINT AS side, (CASE WHEN sc = c OR sc = [c[2], c[3], c[1]] OR sc = [c[3], c[1], c[2]] THEN 1 ELSE -1 END)::BIGINT AS sense, count(*) AS n FROM hf JOIN f USING (k) GROUP BY 1, 2")
add("c05_opposite_sides", lambda s: s.createDataFrame([(f, numbering.opposite_side(model.HEX, 2, f)[1]) for f in range(6)], "face long, opposite long"), f"WITH {S} SELECT a.side::BIGINT AS face, b.side::BIGINT AS opposite FROM sub a JOIN sub b ON a.etype = 9 AND a.subdim = 2 AND b.etype = 9 AND b.subdim = 2 AND NOT list_has_any(a.local, b.local)")
add("c06_match", lambda s: long(s.range(4).select(numbering.match(F.array(*map(F.lit, (5, 7, 9, 11))), F.element_at(F.array(*(F.array(*map(F.lit, c)) for c in ((9, 11, 5, 7), (7, 5, 11, 9), (5, 9, 7, 11), (5, 7, 9, 11)))), (F.col("id") + 1).cast("int"))).alias("m"), "id").select("id", "m.direct", "m.offset"), "direct", "offset"), "SELECT * FROM (VALUES (0::BIGINT, 1::BIGINT, 2::BIGINT), (1, -1, 1), (2, 0, -1), (3, 1, 0)) v(id, direct, \"offset\")")
add("c07_side_element", lambda s: adj.sub_entities(hexes(s).elements, 2).filter("side = 3").select("elem", text("key").alias("key")), f"{HEX}{half('bh', 9, 2)} SELECT elem, {K} FROM hf WHERE side = 3")
add("c08_mid_nodes", lambda s: s.createDataFrame([(e, n, *numbering.mid_nodes(e, n)) for e, n in ((2, 3), (2, 6), (3, 8), (3, 9), (5, 10), (9, 20), (9, 27), (9, 8), (1, 3))], "etype long, n long, e boolean, f boolean, v boolean"), "SELECT * FROM (VALUES (2::BIGINT, 3::BIGINT, false, false, false), (2, 6, true, false, false), (3, 8, true, false, false), (3, 9, true, true, false), (5, 10, true, false, false), (9, 20, true, false, false), (9, 27, true, true, true), (9, 8, false, false, false), (1, 3, true, false, false)) t(etype, n, e, f, v)")
add("c09_types", lambda s: s.createDataFrame([(i, model.ETYPES[i], model.DIMENSIONS[i]) for i in range(12)], "etype long, name string, dim long"), "SELECT * FROM (VALUES (0::BIGINT,'VERTEX',0::BIGINT),(1,'EDGE',1),(2,'TRI',2),(3,'QUAD',2),(4,'POLYGON',2),(5,'TET',3),(6,'PYRAMID',3),(7,'PRISM',3),(8,'KNIFE',3),(9,'HEX',3),(10,'POLYHEDRON',3),(11,'ENTITYSET',4)) t(etype, name, dim)")
add("c10_permutation", lambda s: hexes(s).elements.select("handle", text(F.transform(F.array(*map(F.lit, (0, 3, 2, 1, 4, 7, 6, 5))), lambda i: F.element_at("conn", i + 1))).alias("conn")), f"{HEX} SELECT handle, array_to_string(list_transform([0,3,2,1,4,7,6,5], lambda i: conn[i + 1]), ',') AS conn FROM bh")

# adjacency -------------------------------------------------------------------------------
add("a03_vertex_to_hex", lambda s: adj.pairs(hexes(s), hexes(s).vertices.select("handle"), 3), f"{HEX} SELECT unnest(conn) AS source, handle AS target FROM bh")
add("a04_hex_to_vertex", lambda s: adj.downward(hexes(s), hexes(s).elements.select("handle"), 0), f"{HEX} SELECT handle AS source, unnest(conn) AS target FROM bh")
add("a04_down_to_edges", lambda s: _with_edges(s).groupBy("source").agg(F.count("*").alias("n")), f"{QUAD} SELECT handle AS source, 4::BIGINT AS n FROM qh")
add("a05_face_to_hex", lambda s: _faces_up(s), f"{HEX}{half('bh', 9, 2)}, f AS (SELECT k, row_number() OVER (ORDER BY k) AS n FROM (SELECT DISTINCT k FROM hf)) SELECT {(model.QUAD << 56)} + n AS source, elem AS target FROM hf JOIN f USING (k)")
add("a07_create_edges", lambda s: adj.missing(hexes(s), hexes(s).elements.select("handle"), 1).select(text("key").alias("key")), f"{HEX}{half('bh', 9, 1)} SELECT DISTINCT {K} FROM hf")
add("a07_create_faces", lambda s: adj.create_missing(hexes(s), hexes(s).elements.select("handle"), 2).elements.filter("etype = 3").select("handle", text(numbering.key(F.col("conn"))).alias("key")), f"{HEX}{half('bh', 9, 2)} SELECT {(model.QUAD << 56)} + row_number() OVER (ORDER BY k) AS handle, {K} FROM (SELECT DISTINCT k FROM hf)")
add("a09_bridge_layers", lambda s: adj.bridge(hexes(s), hexes(s).elements.filter("handle % 100 = 1").select("handle"), 0, 3, 2), f"{HEX}, src AS (SELECT * FROM bh WHERE handle % 100 = 1), one AS (SELECT DISTINCT b.* FROM src a JOIN bh b ON abs(a.i-b.i) <= 1 AND abs(a.j-b.j) <= 1 AND abs(a.k-b.k) <= 1) SELECT DISTINCT b.handle FROM one a JOIN bh b ON abs(a.i-b.i) <= 1 AND abs(a.j-b.j) <= 1 AND abs(a.k-b.k) <= 1")
add("a09_bridge_layers_all", lambda s: adj.bridge(hexes(s), hexes(s).elements.select("handle"), 0, 3, 2), f"{HEX}, src AS (SELECT * FROM bh), one AS (SELECT DISTINCT b.* FROM src a JOIN bh b ON abs(a.i-b.i) <= 1 AND abs(a.j-b.j) <= 1 AND abs(a.k-b.k) <= 1) SELECT DISTINCT b.handle FROM one a JOIN bh b ON abs(a.i-b.i) <= 1 AND abs(a.j-b.j) <= 1 AND abs(a.k-b.k) <= 1")
add("a10_face_neighbours", lambda s: adj.neighbours(hexes(s), 3), f"{HEX} SELECT a.handle AS elem, b.handle AS other FROM bh a JOIN bh b ON abs(a.i-b.i) + abs(a.j-b.j) + abs(a.k-b.k) = 1")
add("a10_vertex_neighbours", lambda s: adj.neighbours(quads(s), 2, 0), f"{QUAD} SELECT a.handle AS elem, b.handle AS other FROM qh a JOIN qh b ON abs(a.i-b.i) <= 1 AND abs(a.j-b.j) <= 1 AND a.handle <> b.handle")
add("a10_bridge_of_one", lambda s: adj.bridge_of(hexes(s), (9 << 56) | 50, 0, 3), f"{HEX} SELECT b.handle FROM bh a JOIN bh b ON abs(a.i-b.i) <= 1 AND abs(a.j-b.j) <= 1 AND abs(a.k-b.k) <= 1 WHERE a.handle = {(9 << 56) | 50} AND b.handle <> a.handle")
add("a11_manifold", lambda s: _manifold(s), f"{QUAD}{half('qh', 3, 1)} SELECT {K} FROM hf GROUP BY k HAVING count(*) <= 1")
add("a12_star_rings", lambda s: adj.star_ring(quads(s)).join(_inner(s), "vertex").groupBy("vertex").agg(F.count("*").alias("n"), F.min("face").alias("first")), f"{QUAD} SELECT vertex, count(*) AS n, min(c.handle) AS first FROM (SELECT unnest(conn) AS vertex, handle FROM qh) c JOIN qv ON qv.handle = vertex WHERE i BETWEEN 1 AND 7 AND j BETWEEN 1 AND 7 GROUP BY 1")
add("a13_common", lambda s: adj.common(hexes(s), 100, 101, 3), f"{HEX} SELECT handle FROM bh WHERE list_contains(conn, 100) AND list_contains(conn, 101)")
add("a13_opposite_vertex", lambda s: long(adj.opposite_vertex(tets(s), 3), "side"), f"{TET}{half('bt', 5, 2)} SELECT elem, side::BIGINT AS side, list_filter(conn, lambda v: NOT list_contains(sc, v))[1] AS vertex FROM hf JOIN bt ON handle = elem")
add("a15_half_facets", lambda s: long(adj.facets(tets(s), 3).select("elem", "side", text("key").alias("key")), "side"), f"{TET}{half('bt', 5, 2)} SELECT elem, side::BIGINT AS side, {K} FROM hf")
add("a16_tet_neighbours", lambda s: adj.neighbours(tets(s), 3), f"{TET}{half('bt', 5, 2)} SELECT a.elem, b.elem AS other FROM hf a JOIN hf b ON a.k = b.k AND a.elem <> b.elem")
add("a17_border_vertices", lambda s: adj.border_vertices(quads(s), 2), f"{QUAD} SELECT handle FROM qv WHERE i IN (0, 8) OR j IN (0, 8)")
add("a17_nonmanifold", lambda s: adj.nonmanifold_facets(quads(s), 2).select(text("key").alias("key"), "n"), f"{QUAD}{half('qh', 3, 1)} SELECT {K}, count(*) AS n FROM hf GROUP BY k HAVING count(*) > 2")


def _inner(s):
    return Box((0, 0, 0), (8, 8, 0)).vertices(s).filter("i BETWEEN 1 AND 7 AND j BETWEEN 1 AND 7").select(F.col("handle").alias("vertex"))


def _with_edges(s):
    m = adj.create_missing(quads(s), quads(s).elements.select("handle"), 1)
    return adj.downward(m, m.elements.filter("etype = 3").select("handle"), 1)


def _faces_up(s):
    m = adj.create_missing(hexes(s), hexes(s).elements.select("handle"), 2)
    return adj.upward(m, m.elements.filter("etype = 3").select("handle"), 3)


def _manifold(s):
    m = adj.create_missing(quads(s), quads(s).elements.select("handle"), 1)
    found = adj.manifold(m, m.vertices.select("handle"), 1)
    return m.elements.join(found, "handle", "left_semi").select(text(numbering.key(F.col("conn"))).alias("key"))


# skins -------------------------------------------------------------------------------------
SKIN = "SELECT k, min(elem) AS elem, min(side) AS side FROM hf GROUP BY k HAVING count(*) = 1"
add("k01_skin_hex", lambda s: skinning.skin_facets(hexes(s), 3).select("elem", F.col("side").cast("long"), text("key").alias("key")), f"{HEX}{half('bh', 9, 2)} SELECT elem, side::BIGINT AS side, {K} FROM ({SKIN})")
add("k01_skin_tet", lambda s: skinning.skin_facets(tets(s), 3).select("elem", F.col("side").cast("long"), text("key").alias("key")), f"{TET}{half('bt', 5, 2)} SELECT elem, side::BIGINT AS side, {K} FROM ({SKIN})")
add("k01_skin_vertices", lambda s: skinning.skin_vertices(hexes(s), 3), f"{HEX} SELECT handle FROM bv WHERE i IN (0, {N}) OR j IN (0, {N}) OR k IN (0, {N})")
add("k02_reversed_skin", lambda s: skinning.existing_skin(adj.create_missing(quads(s), quads(s).elements.select("handle"), 1), 2).groupBy("reverse").agg(F.count("*").alias("n")), "SELECT false AS reverse, 32::BIGINT AS n")
add("k04_skin_of_edges", lambda s: skinning.skin_vertices(_path(s), 1), "SELECT unnest([1, 20])::BIGINT AS handle")
add("k05_skin_edges", lambda s: skinning.skin_by_dimension(hexes(s), 3, 1).select(text("key").alias("key")), f"{HEX}{half('bh', 9, 2)}, sk AS ({SKIN}), q AS (SELECT sc FROM sk JOIN hf USING (elem, side)), e AS (SELECT list_sort([sc[x + 1], sc[(x + 1) % 4 + 1]]) AS k FROM q, range(4) r(x)) SELECT DISTINCT {K} FROM e")
add("k06_padded_polygons", lambda s: skinning.skin_facets(_padded(s), 2).select(text("key").alias("key")), "SELECT unnest(['1,2','2,3','1,4','3,5','4,5']) AS key")
add("k07_skin_by_bounds", lambda s: long(t.box(N).skin(s), "side"), f"{HEX}{half('bh', 9, 2)} SELECT elem, side::BIGINT AS side FROM ({SKIN})")
add("k09_edge_classes", lambda s: skinning.classify_edges(quads(s)).select(text("key").alias("key"), "kind"), f"{QUAD}{half('qh', 3, 1)} SELECT {K}, CASE WHEN count(*) = 1 THEN 'boundary' ELSE 'other' END AS kind FROM hf GROUP BY k")
add("k10_depth", lambda s: long(skinning.depth(hexes(s), 3), "depth"), f"{HEX} SELECT handle, least(i, j, k, {N - 1} - i, {N - 1} - j, {N - 1} - k)::BIGINT AS depth FROM bh")
add("k11_box", lambda s: t.box(N).mesh(s).elements.select("handle", text("conn").alias("conn")), f"{HEX} SELECT handle, array_to_string(conn, ',') AS conn FROM bh")
add("k11_box_vertices", lambda s: t.hex_mesh(s, N, True).vertices, f"WITH {t.hex_sql(N, True)} SELECT handle, x, y, z FROM bv")
add("k11_periodic", lambda s: Box((0, 0, 0), (7, 4, 0), (True, False)).elements(s).select("handle", text("conn").alias("conn")), f"SELECT {3 << 56} + 1 + i + 8*j AS handle, concat_ws(',', 1 + i + 8*j, 1 + (i+1)%8 + 8*j, 1 + (i+1)%8 + 8*(j+1), 1 + i + 8*(j+1)) AS conn FROM range(8) a(i), range(4) b(j)")
add("k12_params", lambda s: t.box(N).params(hexes(s).elements.select("handle")), f"{HEX} SELECT handle, i, j, k FROM bh")
add("k12_params_vertices", lambda s: t.box(N).params(hexes(s).vertices.select("handle")), f"{HEX} SELECT handle, i, j, k FROM bv")
add("k13_grid_edges", lambda s: t.box(N).adjacent_edge(s, 1).select("v0", "v1"), f"{HEX} SELECT handle AS v0, handle + {N + 1} AS v1 FROM bv WHERE j < {N}")
add("k15_partition", lambda s: s.createDataFrame([(i, *lo, *hi) for i, (lo, hi) in enumerate(partition((0, 0, 0), (10, 23, 7), 5))], "part long, i0 long, j0 long, k0 long, i1 long, j1 long, k1 long"), "SELECT p AS part, 0::BIGINT AS i0, p*4 + least(p, 3) AS j0, 0::BIGINT AS k0, 10::BIGINT AS i1, (p+1)*4 + least(p+1, 3) AS j1, 7::BIGINT AS k1 FROM range(5) t(p)")
add("k15_partition_square", lambda s: s.createDataFrame([(len(partition((0, 0, 0), (12, 12, 6), 6, m)), m) for m in ("alljkbal", "sqij", "sqjk", "sqijk")], "n long, method string"), "SELECT 6::BIGINT AS n, unnest(['alljkbal', 'sqij', 'sqjk', 'sqijk']) AS method")
add("k19_refine_quads", lambda s: _counts(mutation.refine(quads(s), model.QUAD)), "SELECT 289::BIGINT AS vertices, 256::BIGINT AS elements")
add("k19_refine_tris", lambda s: _counts(mutation.refine(tris(s), model.TRI)), "SELECT 289::BIGINT AS vertices, 512::BIGINT AS elements")
add("k19_refine_hexes", lambda s: _counts(mutation.refine(t.hex_mesh(s, 3), model.HEX)), "SELECT 343::BIGINT AS vertices, 216::BIGINT AS elements")
add("k19_refine_tris_by_3", lambda s: _counts(mutation.refine(tris(s), model.TRI, 3)), "SELECT 625::BIGINT AS vertices, 1152::BIGINT AS elements")
add("k19_refine_quads_by_5", lambda s: _counts(mutation.refine(quads(s), model.QUAD, 5)), "SELECT 1681::BIGINT AS vertices, 1600::BIGINT AS elements")
add("k19_refine_hexes_by_3", lambda s: _counts(mutation.refine(t.hex_mesh(s, 2), model.HEX, 3)), "SELECT 343::BIGINT AS vertices, 216::BIGINT AS elements")
add("k19_refine_tets", lambda s: _tet_volumes(mutation.refine(tets(s), model.TET, 2)), "SELECT 343::BIGINT AS vertices, 1296::BIGINT AS n, 20833::BIGINT AS low, 20833::BIGINT AS high, 27000000::BIGINT AS total")
add("k19_hierarchy", lambda s: _levels(mutation.hierarchy(t.tri_mesh(s, 3), model.TRI, [2, 3])), "SELECT * FROM (VALUES (0::BIGINT, 16::BIGINT, 18::BIGINT), (1, 49, 72), (2, 361, 648)) v(level, vertices, elements)")
add("k19_refined_volume", lambda s: _volume(mutation.refine(t.hex_mesh(s, 3), model.HEX)), "SELECT 27000000::BIGINT AS volume, 216::BIGINT AS positive")
add("k20_parents", lambda s: mutation.refine(quads(s), model.QUAD).elements.select("handle", mutation.parent_of(H(), 4).alias("parent")), f"SELECT {3 << 56} + c AS handle, {3 << 56} + (c - 1) // 4 + 1 AS parent FROM range(1, 257) t(c)")
add("k21_on_boundary", lambda s: skinning.on_boundary(hexes(s), 3), f"{HEX} SELECT handle, (i IN (0, {N - 1}) OR j IN (0, {N - 1}) OR k IN (0, {N - 1})) AS boundary FROM bh")
add("m05_merge_mesh", lambda s: _stitched(s), "SELECT 4::BIGINT AS merged, 12::BIGINT AS vertices")
add("m09_mid_edge_nodes", lambda s: _counts(mutation.add_mid_edge_nodes(hexes(s), 3)), f"{HEX}{half('bh', 9, 1)} SELECT (SELECT count(*) FROM bv) + (SELECT count(DISTINCT k) FROM hf) AS vertices, (SELECT count(*) FROM bh) AS elements")
add("m09_back_to_corners", lambda s: _counts(mutation.remove_higher_order(mutation.add_mid_edge_nodes(hexes(s), 3))), f"{HEX} SELECT (SELECT count(*) FROM bv) AS vertices, (SELECT count(*) FROM bh) AS elements")
add("h09_lloyd", lambda s: _moved(mutation.smooth(t.quad_mesh(s, 8, True), 2, 1)), f"WITH {t.quad_sql(8, True)}, inc AS (SELECT handle AS elem, unnest(conn) AS v FROM qh), c AS (SELECT elem, avg(z) AS z FROM inc JOIN qv ON v = handle GROUP BY 1), m AS (SELECT v, avg(z) AS z FROM inc JOIN c USING (elem) GROUP BY 1) SELECT handle, floor((CASE WHEN i IN (0, 8) OR j IN (0, 8) THEN qv.z ELSE m.z END) * 1e6 + 0.5)::BIGINT AS z FROM qv JOIN m ON v = handle")
add("z04_laplace", lambda s: _moved(mutation.smooth(t.quad_mesh(s, 8, True), 2, 1, method="laplace")), f"WITH {t.quad_sql(8, True)}, m AS (SELECT a.handle AS v, avg(b.z) AS z FROM qv a JOIN qv b ON abs(a.i-b.i) + abs(a.j-b.j) = 1 GROUP BY 1) SELECT handle, floor((CASE WHEN i IN (0, 8) OR j IN (0, 8) THEN qv.z ELSE m.z END) * 1e6 + 0.5)::BIGINT AS z FROM qv JOIN m ON v = handle")
add("d04_ghosts", lambda s: distribution.ghosts(hexes(s), _slabs(s), 3, 0, 1), f"{HEX} SELECT DISTINCT a.k // 2 AS part, b.handle FROM bh a JOIN bh b ON abs(a.i-b.i) <= 1 AND abs(a.j-b.j) <= 1 AND abs(a.k-b.k) <= 1 WHERE a.k // 2 <> b.k // 2")
add("d01_interface", lambda s: distribution.interface_vertices(hexes(s), _slabs(s)), f"{HEX}, u AS (SELECT DISTINCT unnest(conn) AS gid, k // 2 AS part FROM bh) SELECT gid, part FROM u WHERE gid IN (SELECT gid FROM u GROUP BY 1 HAVING count(*) > 1)")
add("d06_part_neighbours", lambda s: distribution.part_neighbours(hexes(s), _slabs(s)), f"SELECT a AS part, b AS other, {(N + 1) ** 2}::BIGINT AS n FROM range(3) x(a), range(3) y(b) WHERE abs(a - b) = 1")
add("d10_bisect", lambda s: distribution.bisect(hexes(s).vertices, 2).groupBy("part").agg(F.count("*").alias("n")), "SELECT * FROM (VALUES (0::BIGINT, 86::BIGINT), (1, 86), (2, 86), (3, 85)) t(part, n)")
add("d10_curve", lambda s: distribution.curve_partition(hexes(s).vertices, 7, 1.0).groupBy("part").agg(F.count("*").alias("n")), "SELECT p AS part, 49::BIGINT AS n FROM range(7) t(p)")
add("d10_round_robin", lambda s: distribution.round_robin(hexes(s).elements, 5).groupBy("part").agg(F.count("*").alias("n")), f"{HEX} SELECT handle % 72057594037927936 % 5 AS part, count(*) AS n FROM bh GROUP BY 1")


def _path(s):
    rows = [((1 << 56) | i, 1, [i, i + 1]) for i in range(1, 20)]
    return model.Mesh(s.range(1, 21).select(F.col("id").alias("handle"), F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z")), s.createDataFrame(rows, "handle long, etype int, conn array<long>"))


def _padded(s):
    return model.mesh_from_arrays(s, [(float(i), 0.0, 0.0) for i in range(5)], [("POLYGON", [0, 1, 2, 2, 2]), ("POLYGON", [0, 2, 4, 3, 3])])


def _counts(m):
    return m.spark.range(1).select(F.lit(m.vertices.count()).cast("long").alias("vertices"), F.lit(m.elements.count()).cast("long").alias("elements"))


def _tet_volumes(m):
    from ..operators.measures import measures

    v = F.col("measure")
    micro = lambda c: F.floor(c * 1e6 + 0.5).cast("long")
    return measures(m, 3).agg(F.count("*").alias("n"), micro(F.min(v)).alias("low"), micro(F.max(v)).alias("high"), micro(F.sum(v)).alias("total")).withColumn("vertices", F.lit(m.vertices.count()).cast("long"))


def _levels(levels):
    out = None
    for i, m in enumerate(levels):
        row = _counts(m).withColumn("level", F.lit(i).cast("long"))
        out = row if out is None else out.unionByName(row)
    return out


def _volume(m):
    from ..operators.measures import quality_of

    q = quality_of(m, model.HEX, ["volume", "jacobian"])
    return q.agg(F.floor(F.sum("volume") * 1e6 + 0.5).cast("long").alias("volume"), F.sum(F.when(F.col("jacobian") > 0, 1).otherwise(0)).cast("long").alias("positive"))


def _stitched(s):
    c = [(x, y, z) for x0 in (0, 1) for x, y, z in ((x0, 0, 0), (x0 + 1, 0, 0), (x0 + 1, 1, 0), (x0, 1, 0), (x0, 0, 1), (x0 + 1, 0, 1), (x0 + 1, 1, 1), (x0, 1, 1))]
    m = model.mesh_from_arrays(s, c, [("HEX", list(range(8))), ("HEX", list(range(8, 16)))])
    out = mutation.merge_vertices(m, 1e-3, 3)
    return s.range(1).select(F.lit(m.vertices.count() - out.vertices.count()).cast("long").alias("merged"), F.lit(out.vertices.count()).cast("long").alias("vertices"))


def _moved(df):
    return df.select("handle", F.floor(F.col("z") * 1e6 + 0.5).cast("long").alias("z"))


def _slabs(s):
    return t.box(N).elements(s).select("handle", F.floor(F.col("k") / 2).alias("part"))


