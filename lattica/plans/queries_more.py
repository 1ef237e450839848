"""Registered queries: dual meshes, senses, oriented boxes, extrusion, further predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import model
from ..functions import geometry as G
from ..functions.geometry import V
from ..operators import measures, topology
from . import tables as t
from .queries_geometry import micro, u

QUERIES, ORACLE = {}, {}
N = 4


def add(name, run, sql):
    QUERIES[name] = run
    ORACLE[name] = sql


HEX = f"WITH {t.hex_sql(N)}"
_groups = lambda s: t.box(N).elements(s).select(F.floor(F.col("k") / 2).alias("group"), "handle")
_senses = lambda s: topology.senses(t.hex_mesh(s, N), _groups(s), 3)
add("k23_dual_edges", lambda s, d: topology.dual_edges(t.hex_mesh(s, N), 3), f"{HEX} SELECT a.handle AS a, b.handle AS b FROM bh a JOIN bh b ON abs(a.i-b.i) + abs(a.j-b.j) + abs(a.k-b.k) = 1 AND a.handle < b.handle")
add("k23_dual_sheets", lambda s, d: topology.dual_hyperplanes(t.hex_mesh(s, N), 3).groupBy("sheet").agg(F.count("*").alias("n")).select("n"), f"SELECT {(N + 1) ** 2}::BIGINT AS n FROM range({3 * N})")
add("p18_senses", lambda s, d: _senses(s).groupBy("group", "sense").agg(F.count("*").alias("n")).select("group", F.col("sense").cast("long"), "n"), f"SELECT * FROM (VALUES (0::BIGINT, 1::BIGINT, {2 * N * N + 4 * N * 2}::BIGINT), (1, 1, {N * N + 4 * N * 2}), (1, -1, {N * N})) v(\"group\", sense, n)")
add("p18_complement", lambda s, d: topology.implicit_complement(_senses(s)).groupBy("sense").agg(F.count("*").alias("n")).select(F.col("sense").cast("long"), "n"), f"SELECT -1::BIGINT AS sense, {6 * N * N}::BIGINT AS n")
add("p18_other_group", lambda s, d: topology.other_group(_senses(s)).groupBy("group", "other").agg(F.count("*").alias("n")), f"SELECT * FROM (VALUES (0::BIGINT, 1::BIGINT, {N * N}::BIGINT), (1, 0, {N * N})) v(\"group\", other, n)")
add("p11_oriented_boxes", lambda s, d: _boxes(s), f"SELECT g AS \"group\", 2000000::BIGINT AS l0, 1000000::BIGINT AS l1, 500000::BIGINT AS l2 FROM range(3) r(g)")
add("k24_extrusion", lambda s, d: measures.quality_of(topology.extrude(t.quad_mesh(s, 4), 3, 2.0), model.HEX, ["volume"]).select("handle", micro(F.col("volume")).alias("volume")), f"SELECT {9 << 56} + i AS handle, {u('2.0')} AS volume FROM range(1, 49) r(i)")
add("k24_extruded_prisms", lambda s, d: measures.quality_of(topology.extrude(t.tri_mesh(s, 4), 3, 2.0), model.PRISM, ["volume"]).select("handle", micro(F.col("volume")).alias("volume")), f"SELECT {7 << 56} + i AS handle, {u('1.0')} AS volume FROM range(1, 97) r(i)")
add("k18_brick_of_tets", lambda s, d: measures.measures(t.tet_mesh(s, N), 3).agg(F.count("*").alias("n"), micro(F.sum("measure")).alias("volume")), f"SELECT {6 * N ** 3}::BIGINT AS n, {u(f'{N ** 3}.0')} AS volume")
add("g02_plucker", lambda s, d: t.points(s, d, 1.0, 0.0).select("pid", G.plucker_ray_triangle(V(F.col("x"), F.col("y"), F.lit(-4.0)), V.const(0, 0, 2), V.const(-1, -1, 0), V.const(1, -1, 0), V.const(-1, 1, 0)).alias("t")).filter("t IS NOT NULL").select("pid", micro(F.col("t")).alias("t")), "WITH " + t.points_sql(1.0, 0.0) + " SELECT pid, 2000000::BIGINT AS t FROM pts WHERE x >= -1 AND y >= -1 AND x + y <= 0")
add("h15_tuples", lambda s, d: t.table(s, d, "lineitem").groupBy("l_orderkey").agg(F.min(F.struct("l_partkey", "l_suppkey")).alias("m")).select("l_orderkey", "m.*"), "SELECT l_orderkey, l_partkey, l_suppkey FROM (SELECT l_orderkey, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey) AS n FROM lineitem) WHERE n = 1")


def _boxes(s):
    """Boxes of three rotated copies of a 4 by 2 by 1 block of points."""
    p = s.range(3 * 5 * 3 * 3)
    g, i, j, k = F.col("id") % 3, F.floor(F.col("id") / 3) % 5, F.floor(F.col("id") / 15) % 3, F.floor(F.col("id") / 45)
    a, b, c = i - 2.0, j - 1.0, (k - 1.0) / 2
    turn = F.col("g") * 0.5
    pts = p.select(g.alias("g"), a.alias("a"), b.alias("b"), c.alias("c")).select(F.col("g").alias("group"), (F.cos(turn) * F.col("a") - F.sin(turn) * F.col("b") + F.col("g")).alias("x"), (F.sin(turn) * F.col("a") + F.cos(turn) * F.col("b")).alias("y"), F.col("c").alias("z"))
    return topology.oriented_boxes(pts).select("group", *(micro(F.col(f"l{i}")).alias(f"l{i}") for i in range(3)))
