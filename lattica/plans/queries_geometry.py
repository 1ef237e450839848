"""Registered queries: measures, quality, spatial search, fields and remapping on generated meshes."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from .. import model
from ..functions import geometry as G
from ..functions import quality
from ..functions.geometry import V
from ..operators import fields, measures, remap, spatial
from ..operators.fixpoint import store
from ..operators.structured import Box
from . import tables as t

QUERIES, ORACLE = {}, {}


def H():
    return F.col("handle")


HEXQ, TETQ = f"WITH {t.hex_sql(4, True)}", f"WITH {t.tet_sql(3, True)}"
QUADQ, TRIQ = f"WITH {t.quad_sql(8, True)}", f"WITH {t.tri_sql(8, True)}"
hexes, tets = lambda s: t.hex_mesh(s, 4, True), lambda s: t.tet_mesh(s, 3, True)
quads, tris = lambda s: t.quad_mesh(s, 8, True), lambda s: t.tri_mesh(s, 8, True)


def add(name, run, sql=None, data=False):
    QUERIES[name] = run if data else lambda s, d: run(s)
    if sql:
        ORACLE[name] = sql


def micro(c):
    return F.floor(c * 1e6 + 0.5).cast("long")


def rounded(df, *names):
    return df.select(*(micro(F.col(c)).alias(c) if c in names else F.col(c) for c in df.columns))


def u(c):
    return f"floor(({c}) * 1e6 + 0.5)::BIGINT"


def corners(cells, points, n):
    """SQL: cells with the coordinates of their ``n`` corners as ``x0, y0, z0, x1, ...``."""
    cols = ", ".join(f"p{i}.{c} AS {c}{i}" for i in range(n) for c in "xyz")
    joins = " ".join(f"JOIN {points} p{i} ON p{i}.handle = e.conn[{i + 1}]" for i in range(n))
    return f", pc AS (SELECT e.handle, {cols} FROM {cells} e {joins})"


def d2(a, b):
    return "(" + " + ".join(f"({c}{b}-{c}{a})*({c}{b}-{c}{a})" for c in "xyz") + ")"


def det(a, b, c, o):
    """SQL: determinant of the vectors from corner ``o`` to three others."""
    v = {k: [f"({x}{k}-{x}{o})" for x in "xyz"] for k in (a, b, c)}
    p, q, r = v[a], v[b], v[c]
    return f"({p[0]}*({q[1]}*{r[2]}-{q[2]}*{r[1]}) + {p[1]}*({q[2]}*{r[0]}-{q[0]}*{r[2]}) + {p[2]}*({q[0]}*{r[1]}-{q[1]}*{r[0]}))"


def cross2(a, b, o):
    """SQL: squared length of the cross product of two edges from corner ``o``."""
    p, q = ([f"({x}{k}-{x}{o})" for x in "xyz"] for k in (a, b))
    parts = [f"({p[i]}*{q[j]}-{p[j]}*{q[i]})" for i, j in ((1, 2), (2, 0), (0, 1))]
    return "(" + " + ".join(f"{x}*{x}" for x in parts) + ")"


T3, T4, Q4, H8 = corners("qt", "qv", 3), corners("bt", "bv", 4), corners("qh", "qv", 4), corners("bh", "bv", 8)

# boxes, positions, measures ---------------------------------------------------------------
add("p01_bounding_box", lambda s, d: spatial.bounding_box(t.orders_mesh(s, d)).drop("diagonal"), t.ORDERS_SQL + "SELECT min(x) AS x0, min(y) AS y0, min(z) AS z0, max(x) AS x1, max(y) AS y1, max(z) AS z1 FROM vtx", True)
add("p01_element_boxes", lambda s, d: spatial.bounds(t.orders_mesh(s, d), 2), t.ORDERS_SQL + "SELECT elem AS handle, min(x) AS x0, min(y) AS y0, min(z) AS z0, max(x) AS x1, max(y) AS y1, max(z) AS z1 FROM inc JOIN vtx ON vertex = handle WHERE (elem >> 56) IN (2, 3, 4) GROUP BY 1", True)
add("g09_centroids", lambda s: rounded(measures.centroids(hexes(s), 3), "x", "y", "z"), f"{HEXQ} SELECT e.handle, {u('avg(v.x)')} AS x, {u('avg(v.y)')} AS y, {u('avg(v.z)')} AS z FROM (SELECT handle, unnest(conn) AS c FROM bh) e JOIN bv v ON v.handle = c GROUP BY 1")
add("g09_average_position", lambda s, d: rounded(measures.average_position(t.orders_mesh(s, d), t.orders_mesh(s, d).elements.filter("etype = 2").select("handle")), "x", "y", "z"), t.ORDERS_SQL + f"SELECT {u('avg(x)')} AS x, {u('avg(y)')} AS y, {u('avg(z)')} AS z FROM vtx WHERE handle IN (SELECT vertex FROM inc WHERE (elem >> 56) = 2)", True)
add("g10_edge_lengths", lambda s: rounded(measures.edge_lengths(tris(s), 2).select(F.concat_ws(",", F.transform("key", lambda v: v.cast("string"))).alias("key"), "length"), "length"), f"{TRIQ}, e AS (SELECT DISTINCT least(conn[x+1], conn[(x+1)%3+1]) AS a, greatest(conn[x+1], conn[(x+1)%3+1]) AS b FROM qt, range(3) r(x)) SELECT a || ',' || b AS key, {u('sqrt((p.x-q.x)**2 + (p.y-q.y)**2 + (p.z-q.z)**2)')} AS length FROM e JOIN qv p ON p.handle = a JOIN qv q ON q.handle = b")
add("g10_tri_area", lambda s: rounded(measures.measures(tris(s), 2).select("handle", "measure"), "measure"), f"{TRIQ}{T3} SELECT handle, {u(f'sqrt({cross2(1, 2, 0)}) / 2')} AS measure FROM pc")
add("g10_quad_area", lambda s: rounded(measures.measures(quads(s), 2).select("handle", "measure"), "measure"), f"{QUADQ}{Q4} SELECT handle, {u(f'sqrt({cross2(1, 2, 0)}) / 2 + sqrt({cross2(2, 3, 0)}) / 2')} AS measure FROM pc")
add("g10_tet_volume", lambda s: rounded(measures.measures(tets(s), 3).select("handle", "measure"), "measure"), f"{TETQ}{T4} SELECT handle, {u(f'{det(1, 2, 3, 0)} / 6')} AS measure FROM pc")
FIVE = " + ".join(f"{det(b, c, d, a)}/6" for a, b, c, d in ((0, 1, 3, 4), (7, 3, 6, 4), (4, 5, 1, 6), (1, 6, 3, 4), (2, 6, 3, 1)))
add("g10_hex_volume", lambda s: rounded(measures.measures(hexes(s), 3).select("handle", "measure"), "measure"), f"{HEXQ}{H8} SELECT handle, {u(FIVE)} AS measure FROM pc")
add("g10_orders_edges", lambda s, d: rounded(measures.measures(t.orders_mesh(s, d), 1).select("handle", "measure"), "measure"), t.ORDERS_SQL + f"SELECT e.handle, {u('sqrt((p.x-q.x)**2 + (p.y-q.y)**2 + (p.z-q.z)**2)')} AS measure FROM elem e JOIN vtx p ON p.handle = conn[1] JOIN vtx q ON q.handle = conn[2] WHERE etype = 1", True)
add("h12_size_statistics", lambda s: rounded(measures.size_statistics(tris(s), 2).select(F.col("etype").cast("long"), "n", "minimum", "maximum", "average"), "minimum", "maximum", "average"), f"{TRIQ}{T3}, m AS (SELECT sqrt({cross2(1, 2, 0)}) / 2 AS m FROM pc) SELECT 2::BIGINT AS etype, count(*) AS n, {u('min(m)')} AS minimum, {u('max(m)')} AS maximum, {u('avg(m)')} AS average FROM m")
add("p17_enclosed_volume", lambda s: rounded(measures.enclosed_volume(_surface(s)), "volume"), "SELECT 27000000::BIGINT AS volume")
add("p17_surface_area", lambda s: rounded(measures.surface_area(_surface(s)), "area"), "SELECT 54000000::BIGINT AS area")

# quality ------------------------------------------------------------------------------------
E3 = [d2(0, 1), d2(1, 2), d2(2, 0)]
E4 = [d2(0, 1), d2(1, 2), d2(2, 3), d2(3, 0)]
E6 = [d2(0, 1), d2(1, 2), d2(2, 0), d2(0, 3), d2(1, 3), d2(2, 3)]
EDGES12 = [d2(a, b) for a, b in quality._HEX_EDGES]
ratio = lambda e: f"sqrt(greatest({', '.join(e)}) / least({', '.join(e)}))"
add("v01_edge", lambda s: rounded(measures.quality_of(_edges(s), model.EDGE, ["length"]), "length"), f"SELECT {1 << 56} + i AS handle, {u('sqrt(i*i + 4.0 + 9.0)')} AS length FROM range(1, 30) t(i)")
add("v02_tri", lambda s: rounded(measures.quality_of(tris(s), model.TRI, ["edge_ratio", "area", "scaled_jacobian", "aspect_frobenius"]), "edge_ratio", "area", "scaled_jacobian", "aspect_frobenius"), f"{TRIQ}{T3} SELECT handle, {u(ratio(E3))} AS edge_ratio, {u(f'sqrt({cross2(1, 2, 0)}) / 2')} AS area, {u(f'2 / sqrt(3.0) * sqrt({cross2(1, 2, 0)}) / sqrt(greatest({E3[0]}*{E3[1]}, {E3[1]}*{E3[2]}, {E3[2]}*{E3[0]}))')} AS scaled_jacobian, {u(f'({E3[0]}+{E3[1]}+{E3[2]}) / (2*sqrt(3.0)*sqrt({cross2(1, 2, 0)}))')} AS aspect_frobenius FROM pc")
add("v03_quad", lambda s: rounded(measures.quality_of(quads(s), model.QUAD, ["edge_ratio", "stretch"]), "edge_ratio", "stretch"), f"{QUADQ}{Q4} SELECT handle, {u(ratio(E4))} AS edge_ratio, {u(f'sqrt(2.0) * sqrt(least({', '.join(E4)}) / greatest({d2(0, 2)}, {d2(1, 3)}))')} AS stretch FROM pc")
add("v04_tet", lambda s: rounded(measures.quality_of(tets(s), model.TET, ["edge_ratio", "volume", "jacobian"]), "edge_ratio", "volume", "jacobian"), f"{TETQ}{T4} SELECT handle, {u(ratio(E6))} AS edge_ratio, {u(f'{det(1, 2, 3, 0)} / 6')} AS volume, {u(det(1, 2, 3, 0))} AS jacobian FROM pc")
_AX = [[f"({'+'.join(f'{c}{i}' for i in p)}-{'-'.join(f'{c}{i}' for i in m)})" for c in "xyz"] for p, m in (((1, 2, 5, 6), (0, 3, 4, 7)), ((2, 3, 6, 7), (0, 1, 4, 5)), ((4, 5, 6, 7), (0, 1, 2, 3)))]
_A, _B, _C = _AX
_AXDET = f"({_A[0]}*({_B[1]}*{_C[2]}-{_B[2]}*{_C[1]}) + {_A[1]}*({_B[2]}*{_C[0]}-{_B[0]}*{_C[2]}) + {_A[2]}*({_B[0]}*{_C[1]}-{_B[1]}*{_C[0]}))"
_DIAG = [d2(a, b) for a, b in quality._HEX_DIAGONALS]
_JAC = ", ".join([det(*f, c) for c, f in enumerate(quality._HEX_CORNERS)] + [f"{_AXDET} / 64"])
add("v05_hex", lambda s: rounded(measures.quality_of(hexes(s), model.HEX, ["edge_ratio", "volume", "stretch", "diagonal", "jacobian"]), "edge_ratio", "volume", "stretch", "diagonal", "jacobian"), f"{HEXQ}{H8} SELECT handle, {u(ratio(EDGES12))} AS edge_ratio, {u(f'{_AXDET} / 64')} AS volume, {u(f'sqrt(3.0) * sqrt(least({', '.join(EDGES12)})) / sqrt(greatest({', '.join(_DIAG)}))')} AS stretch, {u(f'sqrt(least({', '.join(_DIAG)})) / sqrt(greatest({', '.join(_DIAG)}))')} AS diagonal, {u(f'least({_JAC})')} AS jacobian FROM pc")
add("v06_wedge_volume", lambda s: rounded(measures.quality_of(_wedges(s), model.PRISM, ["volume"]), "volume"), f"SELECT {7 << 56} + i AS handle, {u('i * 3.0')} AS volume FROM range(1, 20) t(i)")
add("h13_quality_statistics", lambda s: rounded(measures.quality_statistics(tris(s), model.TRI, ["area", "edge_ratio"]), "low", "high"), f"{TRIQ}{T3}, m AS (SELECT sqrt({cross2(1, 2, 0)}) / 2 AS a, {ratio(E3)} AS r FROM pc) SELECT 'area' AS metric, count(*) AS n, {u('min(a)')} AS low, {u('max(a)')} AS high FROM m UNION ALL SELECT 'edge_ratio', count(*), {u('min(r)')}, {u('max(r)')} FROM m")
add("z05_histogram", lambda s: measures.quality_histogram(tris(s), model.TRI, "area", 4.3, 8.3, 8), f"{TRIQ}{T3}, m AS (SELECT sqrt({cross2(1, 2, 0)}) / 2 AS a FROM pc) SELECT CASE WHEN a < 4.3 THEN 0 WHEN a >= 8.3 THEN 9 ELSE floor((a - 4.3) / 0.5)::BIGINT + 1 END AS bin, count(*) AS n FROM m GROUP BY 1")
add("z03_objective", lambda s: measures.quality_of(tets(s), model.TET, ["volume"]).agg(*(micro(x).alias(n) for n, x in (("lp2", F.sum(F.col("volume") ** 2)), ("top", F.max("volume")), ("pmean", F.sqrt(F.avg(F.col("volume") ** 2))), ("variance", F.var_pop("volume"))))), f"{TETQ}{T4}, m AS (SELECT {det(1, 2, 3, 0)} / 6 AS v FROM pc) SELECT {u('sum(v*v)')} AS lp2, {u('max(v)')} AS top, {u('sqrt(avg(v*v))')} AS pmean, {u('var_pop(v)')} AS variance FROM m")


def _edges(s):
    m = s.range(1, 30)
    v = m.select(F.col("id").alias("handle"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z")).union(m.select(F.col("id") + 100, F.col("id").cast("double"), F.lit(2.0), F.lit(-3.0)))
    return model.Mesh(v, m.select(model.handle(1, F.col("id")).alias("handle"), F.lit(1).alias("etype"), F.array("id", F.col("id") + 100).alias("conn")))


def _wedges(s):
    c = [(0.0, 0.0, 0.0), (2.0, 0.0, 0.0), (0.0, 3.0, 0.0)]
    cells = s.range(1, 20)
    v = None
    for k, (x, y, z) in enumerate(c + c):
        part = cells.select((F.col("id") * 6 + k).alias("handle"), F.lit(x).alias("x"), F.lit(y).alias("y"), (F.lit(z) + (F.col("id") if k > 2 else 0)).cast("double").alias("z"))
        v = part if v is None else v.unionByName(part)
    return model.Mesh(v, cells.select(model.handle(7, F.col("id")).alias("handle"), F.lit(7).alias("etype"), F.array(*(F.col("id") * 6 + k for k in range(6))).alias("conn")))


def _surface(s, n=3):
    """Outward triangles of a cube's skin: ``(handle, a, b, c)``."""
    from ..operators.skinning import skin_facets

    m = t.hex_mesh(s, n)
    quad = skin_facets(m, 3).select("elem", "side", "sub_conn")
    two = F.array(F.struct(F.lit(0).alias("i"), F.array(*(F.element_at("sub_conn", i) for i in (1, 2, 3))).alias("c")), F.struct(F.lit(1).alias("i"), F.array(*(F.element_at("sub_conn", i) for i in (1, 3, 4))).alias("c")))
    out = quad.select(((model.id_of(F.col("elem")) * 12 + F.col("side") * 2)).alias("h"), F.explode(two).alias("t")).select((F.col("h") + F.col("t.i")).alias("handle"), *(F.element_at("t.c", i + 1).alias(f"v{n}") for i, n in enumerate("abc")))
    for n_ in "abc":
        out = out.join(m.vertices.select(F.col("handle").alias(f"v{n_}"), F.struct("x", "y", "z").alias(n_)), f"v{n_}")
    return out.select("handle", "a", "b", "c")


# spatial -----------------------------------------------------------------------------------
PTS = t.points_sql(1.0, 2.0)
points = lambda s, d: t.points(s, d, 1.0, 2.0)


def _tri_xyz(s):
    return measures.triangles(tris(s))


add("p12_locate_hex", lambda s, d: spatial.locate_in_hexes(points(s, d), t.hex_mesh(s, 4)).select("pid", "handle", *(micro(F.col(c)).alias(c) for c in ("xi", "eta", "zeta"))), f"WITH {PTS} SELECT pid, {9 << 56} + 1 + ceil(x)::BIGINT - 1 + 4*(ceil(y)::BIGINT - 1) + 16*(ceil(z)::BIGINT - 1) AS handle, {u('2*(x - ceil(x)) + 1')} AS xi, {u('2*(y - ceil(y)) + 1')} AS eta, {u('2*(z - ceil(z)) + 1')} AS zeta FROM pts WHERE x BETWEEN 0 AND 4 AND y BETWEEN 0 AND 4 AND z BETWEEN 0 AND 4", True)
add("p12_locate_tet", lambda s, d: spatial.locate_in_tets(points(s, d), t.tet_mesh(s, 4)).select("pid", F.floor((model.id_of(H()) - 1) / 6).alias("cell")), f"WITH {PTS} SELECT pid, ceil(x)::BIGINT - 1 + 4*(ceil(y)::BIGINT - 1) + 16*(ceil(z)::BIGINT - 1) AS cell FROM pts WHERE x BETWEEN 0 AND 4 AND y BETWEEN 0 AND 4 AND z BETWEEN 0 AND 4", True)
add("p03_grid_cells", lambda s, d: spatial.candidates(points(s, d), spatial.bounds(t.hex_mesh(s, 4), 3)).select("pid", "handle"), f"WITH {t.hex_sql(4)}, {PTS} SELECT pid, handle FROM pts p JOIN bh b ON p.x BETWEEN b.i AND b.i + 1 AND p.y BETWEEN b.j AND b.j + 1 AND p.z BETWEEN b.k AND b.k + 1", True)
add("p04_boxes_within", lambda s, d: spatial.candidates(points(s, d), spatial.bounds(t.hex_mesh(s, 4), 3), 0.25).select("pid", "handle"), f"WITH {t.hex_sql(4)}, {PTS} SELECT pid, handle FROM pts p JOIN bh b ON p.x BETWEEN b.i - 0.25 AND b.i + 1.25 AND p.y BETWEEN b.j - 0.25 AND b.j + 1.25 AND p.z BETWEEN b.k - 0.25 AND b.k + 1.25", True)
add("p05_closest_triangle", lambda s, d: spatial.closest_triangle(points(s, d), measures.triangles(t.tri_mesh(s, 8))).select("pid", micro(F.col("squared")).alias("squared")), f"WITH {PTS} SELECT pid, {u('(x - greatest(0, least(8, x)))**2 + (y - greatest(0, least(8, y)))**2 + z*z')} AS squared FROM pts", True)
add("p06_sphere_triangles", lambda s, d: spatial.within_radius(points(s, d), measures.triangles(t.tri_mesh(s, 8)), 2.0).groupBy("pid").agg(micro(F.min("squared")).alias("least")), f"WITH {PTS}, q AS (SELECT pid, (x - greatest(0, least(8, x)))**2 + (y - greatest(0, least(8, y)))**2 + z*z AS d FROM pts) SELECT pid, {u('d')} AS least FROM q WHERE d <= 4", True)
add("p07_axis_rays", lambda s, d: spatial.axis_ray_hits(_origins(s, d), _surface(s)).select("rid", micro(F.col("t")).alias("t"), F.col("direction").cast("long")), f"WITH {t.points_sql(0.7, 1.5)} SELECT pid AS rid, {u('0.0 - (-10.0)')} AS t, -1::BIGINT AS direction FROM pts WHERE y > 0 AND y < 3 AND z > 0 AND z < 3 UNION ALL SELECT pid, {u('13.0')}, 1 FROM pts WHERE y > 0 AND y < 3 AND z > 0 AND z < 3", True)
add("p07_rays", lambda s, d: spatial.ray_hits(_slanted(s, d), _surface(s)).groupBy("rid").agg(F.count("*").alias("n"), micro(F.min("t")).alias("first"), micro(F.max("t")).alias("last")), f"WITH {t.points_sql(0.7, 1.5)}, r AS (SELECT pid, x AS px, y AS py, z AS pz, -0.5 AS dx, 0.25 AS dy, 1.0 AS dz FROM pts), o AS (SELECT pid, px - 8*dx AS ox, py - 8*dy AS oy, pz - 8*dz AS oz, dx, dy, dz FROM r), s AS (SELECT pid, greatest(least((0-ox)/dx, (3-ox)/dx), least((0-oy)/dy, (3-oy)/dy), least((0-oz)/dz, (3-oz)/dz)) AS a, least(greatest((0-ox)/dx, (3-ox)/dx), greatest((0-oy)/dy, (3-oy)/dy), greatest((0-oz)/dz, (3-oz)/dz)) AS b FROM o) SELECT pid AS rid, 2::BIGINT AS n, {u('a')} AS first, {u('b')} AS last FROM s WHERE a < b AND b > 0", True)
add("p14_ray_fire", lambda s, d: spatial.fire(_slanted(s, d), _surface(s), orientation=1).select("rid", micro(F.col("t")).alias("t")), f"WITH {t.points_sql(0.7, 1.5)}, r AS (SELECT pid, x AS px, y AS py, z AS pz, -0.5 AS dx, 0.25 AS dy, 1.0 AS dz FROM pts), o AS (SELECT pid, px - 8*dx AS ox, py - 8*dy AS oy, pz - 8*dz AS oz, dx, dy, dz FROM r), s AS (SELECT pid, greatest(least((0-ox)/dx, (3-ox)/dx), least((0-oy)/dy, (3-oy)/dy), least((0-oz)/dz, (3-oz)/dz)) AS a, least(greatest((0-ox)/dx, (3-ox)/dx), greatest((0-oy)/dy, (3-oy)/dy), greatest((0-oz)/dz, (3-oz)/dz)) AS b FROM o) SELECT pid AS rid, {u('b')} AS t FROM s WHERE a < b AND b > 0", True)
add("p15_inside_volume", lambda s, d: measures.inside_volume(t.points(s, d, 0.7, 1.5).select("pid", F.struct("x", "y", "z").alias("p")), _surface(s)), f"WITH {t.points_sql(0.7, 1.5)} SELECT pid, (x > 0 AND x < 3 AND y > 0 AND y < 3 AND z > 0 AND z < 3) AS inside FROM pts", True)
add("p16_point_in_box", lambda s, d: t.points(s, d, 1.0, 2.0).select("pid", G.boxes_overlap(V(F.col("x"), F.col("y"), F.col("z")), V(F.col("x"), F.col("y"), F.col("z")), V.const(1, 1, 1), V.const(3, 3, 3)).alias("inside")), f"WITH {PTS} SELECT pid, (x BETWEEN 1 AND 3 AND y BETWEEN 1 AND 3 AND z BETWEEN 1 AND 3) AS inside FROM pts", True)
add("p_box_pairs", lambda s: spatial.box_overlap_pairs(spatial.bounds(t.hex_mesh(s, 3), 3), spatial.bounds(t.hex_mesh(s, 4), 3), -0.25), f"WITH {t.hex_sql(3)}, c AS (SELECT {9 << 56} + 1 + i + 4*j + 16*k AS handle, i, j, k FROM range(4) a(i), range(4) b(j), range(4) d(k)) SELECT bh.handle AS a, c.handle AS b FROM bh JOIN c ON bh.i = c.i AND bh.j = c.j AND bh.k = c.k")


def _origins(s, d):
    return t.points(s, d, 0.7, 1.5).select(F.col("pid").alias("rid"), F.lit(-10.0).alias("x"), "y", "z")


def _slanted(s, d):
    o = [F.col(c) - 8 * k for c, k in zip("xyz", (-0.5, 0.25, 1.0))]
    return t.points(s, d, 0.7, 1.5).select(F.col("pid").alias("rid"), V(*o).struct().alias("o"), V.const(-0.5, 0.25, 1.0).struct().alias("d"))


# scalar geometry ---------------------------------------------------------------------------
P = "WITH " + t.points_sql(1.0, 0.0)
_p = lambda s, d: t.points(s, d, 1.0, 0.0)
_v = lambda: V(F.col("x"), F.col("y"), F.col("z"))
add("g01_segment_box", lambda s, d: _p(s, d).select("pid", G.segment_box(_v(), V.const(1, 2, -0.5), V.const(-1, -1, -1), V.const(1, 1, 1), F.lit(-5.0), F.lit(5.0)).alias("r")).filter("r IS NOT NULL").select("pid", micro(F.col("r.start")).alias("start"), micro(F.col("r.end")).alias("end")), P + f", s AS (SELECT pid, greatest(-5.0, least(-1-x, 1-x), least((-1-y)/2, (1-y)/2), least((-1-z)/-0.5, (1-z)/-0.5)) AS a, least(5.0, greatest(-1-x, 1-x), greatest((-1-y)/2, (1-y)/2), greatest((-1-z)/-0.5, (1-z)/-0.5)) AS b FROM pts) SELECT pid, {u('a')} AS start, {u('b')} AS \"end\" FROM s WHERE a <= b", True)
add("g04_ray_box", lambda s, d: _p(s, d).select("pid", G.ray_box(_v(), V.const(1, 0, 0), V.const(0.1, -0.5, -0.5), V.const(2, 0.5, 0.5)).isNotNull().alias("hit")), P + " SELECT pid, (y BETWEEN -0.5 AND 0.5 AND z BETWEEN -0.5 AND 0.5 AND 2 - x >= 0) AS hit FROM pts", True)
add("g03_ray_triangle", lambda s, d: _p(s, d).select("pid", G.ray_triangle(V(F.col("x"), F.col("y"), F.lit(-4.0)), V.const(0, 0, 2), V.const(-1, -1, 0), V.const(1, -1, 0), V.const(-1, 1, 0)).alias("t")).filter("t IS NOT NULL").select("pid", micro(F.col("t")).alias("t")), P + " SELECT pid, 2000000::BIGINT AS t FROM pts WHERE x >= -1 AND y >= -1 AND x + y <= 0", True)
add("g05_box_plane", lambda s, d: _p(s, d).select("pid", G.box_plane_overlap(V.const(1, 1, 1), F.lit(-0.3), V(F.col("x") - 0.2, F.col("y") - 0.2, F.col("z") - 0.2), V(F.col("x") + 0.2, F.col("y") + 0.2, F.col("z") + 0.2)).alias("meets")), P + " SELECT pid, abs(x + y + z - 0.3) <= 0.6 AS meets FROM pts", True)
add("g05_box_tri", lambda s, d: _p(s, d).select("pid", G.box_triangle_overlap(V.const(-9, -9, 0), V.const(9, -9, 0), V.const(0, 20, 0), _v(), V.const(0.25, 0.25, 0.25)).alias("meets")), P + " SELECT pid, abs(z) <= 0.25 AS meets FROM pts", True)
add("g06_closest_on_triangle", lambda s, d: _p(s, d).select("pid", G.closest_on_triangle(_v(), V.const(0, 0, 0), V.const(1, 0, 0), V.const(0, 1, 0)).struct().alias("q")).filter("q.x >= 0 AND q.y >= 0").select("pid", micro(F.col("q.z")).alias("z")), P + " SELECT pid, 0::BIGINT AS z FROM pts", True)
add("g06_closest_on_box", lambda s, d: _p(s, d).select("pid", micro((G.closest_on_box(_v(), V.const(0, 0, 0), V.const(1, 1, 1)) - _v()).length()).alias("d")), P + f" SELECT pid, {u('sqrt((x-greatest(0,least(1,x)))**2 + (y-greatest(0,least(1,y)))**2 + (z-greatest(0,least(1,z)))**2)')} AS d FROM pts", True)
add("g08_vectors", lambda s, d: _p(s, d).select("pid", micro(G.angle(_v(), V.const(1, 0, 0))).alias("angle"), micro(_v().length()).alias("length")), P + f" SELECT pid, {u('acos(greatest(-1, least(1, x / sqrt(x*x+y*y+z*z))))')} AS angle, {u('sqrt(x*x+y*y+z*z)')} AS length FROM pts", True)
add("g11_gnomonic_plane", lambda s, d: _p(s, d).select("pid", G.gnomonic_plane(_v()).cast("long").alias("plane")), P + " SELECT pid, (CASE WHEN abs(z) >= abs(x) AND abs(z) >= abs(y) THEN CASE WHEN z < 0 THEN 5 ELSE 6 END WHEN abs(y) >= abs(x) THEN CASE WHEN y < 0 THEN 4 ELSE 2 END WHEN x < 0 THEN 3 ELSE 1 END)::BIGINT AS plane FROM pts", True)
add("g11_sphere_areas", lambda s: _sphere_areas(s), f"SELECT {u(4 * math.pi)} AS girard, {u(4 * math.pi)} AS lhuilier")
add("g12_fields", lambda s, d: _p(s, d).select("pid", micro(G.slotted_cylinder(F.atan2("y", "x"), F.asin(F.col("z") / _v().length()), 0.5, 0.2, 0.1, 1.0, 0.8)).alias("v")), P + ", q AS (SELECT pid, atan2(y, x) AS lon, asin(z / sqrt(x*x+y*y+z*z)) AS lat FROM pts), r AS (SELECT *, acos(greatest(-1, least(1, sin(0.2)*sin(lat) + cos(0.2)*cos(lat)*cos(lon - 0.5)))) AS r FROM q) SELECT pid, CASE WHEN r <= 0.8 AND (abs(lon - 0.5) >= 0.8 / 6 OR lat - 0.2 < -5.0 / 12 * 0.8) THEN 1000000 ELSE 100000 END::BIGINT AS v FROM r", True)
add("x05_sphere_cell_area", lambda s: _sphere_cells(s), "SELECT 64::BIGINT AS n")


def _sphere(s, n=8):
    """A cube of ``n`` by ``n`` cells a face on the unit sphere: a stored table of corner points, and these as vectors."""
    f = s.range(6 * n * n)
    at = F.col("id")
    face, i, j = F.floor(at / (n * n)), at % n, F.floor(at / n) % n

    def point(a, b):
        u_ = F.tan(((i + a) * 2.0 / n - 1) * math.pi / 4)
        w = F.tan(((j + b) * 2.0 / n - 1) * math.pi / 4)
        one = F.lit(1.0)
        sides = [(one, u_, w), (-u_, one, w), (-one, -u_, w), (u_, -one, w), (-w, u_, one), (w, u_, -one)]
        x, y, z = (F.when(face == 0, sides[0][k]).when(face == 1, sides[1][k]).when(face == 2, sides[2][k]).when(face == 3, sides[3][k]).when(face == 4, sides[4][k]).otherwise(sides[5][k]) for k in range(3))
        return V(x, y, z).unit()

    raw = f.select("id", *(point(a, b).struct().alias(f"p{k}") for k, (a, b) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1)))))
    return store(s, raw), [V.of(f"p{k}") for k in range(4)]


def _sphere_areas(s):
    f, p = _sphere(s)
    return f.select(G.area_girard(p).alias("g"), G.area_lhuilier(p).alias("l")).agg(micro(F.sum("g")).alias("girard"), micro(F.sum("l")).alias("lhuilier"))


def _sphere_cells(s):
    f, p = _sphere(s)
    return f.select(G.area_lhuilier(p).alias("a"), (F.col("id") < 64).alias("one")).filter("one AND a > 0").agg(F.count("*").alias("n"))


# fields --------------------------------------------------------------------------------------
linear = lambda m: m.vertices.select(H().alias("entity"), (F.col("x") * 2 - F.col("y") + F.col("z") * 0.5 + 3).alias("value"))
LIN = u("2*x - y + 0.5*z + 3")
inside = "x BETWEEN 0 AND 4 AND y BETWEEN 0 AND 4 AND z BETWEEN 0 AND 4"
add("h04_linear_tet", lambda s, d: fields.couple(t.tet_mesh(s, 4), points(s, d), model.TET, linear(t.tet_mesh(s, 4))).select("pid", micro(F.col("value")).alias("value")), f"WITH {PTS} SELECT pid, {LIN} AS value FROM pts WHERE {inside}", True)
add("h04_linear_hex", lambda s, d: fields.couple(t.hex_mesh(s, 4), points(s, d), model.HEX, linear(t.hex_mesh(s, 4))).select("pid", micro(F.col("value")).alias("value")), f"WITH {PTS} SELECT pid, {LIN} AS value FROM pts WHERE {inside}", True)
add("h04_constant", lambda s, d: fields.couple(t.hex_mesh(s, 4), points(s, d), model.HEX, t.hex_mesh(s, 4).elements.select(H().alias("entity"), model.id_of(H()).alias("value")), "constant"), f"WITH {PTS} SELECT pid, 1 + ceil(x)::BIGINT - 1 + 4*(ceil(y)::BIGINT - 1) + 16*(ceil(z)::BIGINT - 1) AS value FROM pts WHERE {inside}", True)
add("h02_integral_tets", lambda s: fields.vertex_integrals(t.tet_mesh(s, 4), model.TET, linear(t.tet_mesh(s, 4))).agg(micro(F.sum("integral")).alias("integral")), f"SELECT {u('64 * (4 - 2 + 1 + 3.0)')} AS integral")
add("h02_integral_hexes", lambda s: fields.vertex_integrals(t.hex_mesh(s, 4), model.HEX, linear(t.hex_mesh(s, 4))).agg(micro(F.sum("integral")).alias("integral")), f"SELECT {u('64 * (4 - 2 + 1 + 3.0)')} AS integral")
_grp = lambda s: t.box(4).elements(s).select("handle", F.col("k").alias("group"))
_own = lambda s: t.hex_mesh(s, 4).elements.select(H().alias("entity"), (model.id_of(H()) % 5).cast("double").alias("value"))
add("h07_group_integrals", lambda s: rounded(fields.group_integrals(fields.integrals(t.hex_mesh(s, 4), 3, _own(s)), _grp(s)), "integral"), f"WITH {t.hex_sql(4)} SELECT k AS \"group\", {u(f'sum((handle & {model.ID_MASK}) % 5)')} AS integral FROM bh GROUP BY 1")
add("h05_normalisation", lambda s: rounded(fields.normalisation(fields.group_integrals(fields.integrals(t.hex_mesh(s, 4), 3, _own(s)), _grp(s))), "factor"), f"WITH {t.hex_sql(4)} SELECT k AS \"group\", {u(f'1.0 / sum((handle & {model.ID_MASK}) % 5)')} AS factor FROM bh GROUP BY 1")

# remapping -----------------------------------------------------------------------------------
_src = lambda s: Box((0, 0, 0), (6, 6, 0)).mesh(s, (F.col("i") * 2, F.col("j") * 2, F.lit(0)))
_tgt = lambda s: Box((0, 0, 0), (4, 4, 0)).mesh(s, (F.col("i") * 3, F.col("j") * 3, F.lit(0)))
OV = "WITH s AS (SELECT %d + 1 + i + 6*j AS h, i*2 AS x, j*2 AS y FROM range(6) a(i), range(6) b(j)), g AS (SELECT %d + 1 + i + 4*j AS h, i*3 AS x, j*3 AS y FROM range(4) a(i), range(4) b(j)), o AS (SELECT s.h AS source, g.h AS target, (least(s.x+2, g.x+3) - greatest(s.x, g.x)) * (least(s.y+2, g.y+3) - greatest(s.y, g.y)) AS area FROM s JOIN g ON s.x < g.x+3 AND g.x < s.x+2 AND s.y < g.y+3 AND g.y < s.y+2)" % (3 << 56, 3 << 56)
add("x01_overlap", lambda s: rounded(remap.overlap_in_plane(_src(s), _tgt(s)), "area"), f"{OV} SELECT source, target, {u('area')} AS area FROM o")
add("x07_weights", lambda s: rounded(remap.weights(remap.overlap_in_plane(_src(s), _tgt(s))), "w"), f"{OV} SELECT target AS \"row\", source AS col, {u('area / 9.0')} AS w FROM o")
add("x07_apply", lambda s: rounded(remap.apply(remap.weights(remap.overlap_in_plane(_src(s), _tgt(s))), _src(s).elements.select(H().alias("entity"), (model.id_of(H()) % 7).cast("double").alias("value"))), "value"), f"{OV} SELECT target AS entity, {u(f'sum(area * ((source & {model.ID_MASK}) % 7)) / 9.0')} AS value FROM o GROUP BY 1")
add("x07_properties", lambda s: remap.properties(remap.weights(remap.overlap_in_plane(_src(s), _tgt(s))), _src(s).elements.select("handle", F.lit(4.0).alias("area")), _tgt(s).elements.select("handle", F.lit(9.0).alias("area"))), "SELECT true AS consistent, true AS conservative, true AS monotone")
add("x02_sphere_overlap", lambda s: remap.overlap_on_sphere(_sphere_mesh(s, 4), _sphere_mesh(s, 6)).agg(micro(F.sum("area")).alias("area")), "SELECT 12566371::BIGINT AS area")


def _sphere_mesh(s, n):
    """Quads of the sphere with corners of their own."""
    f, p = _sphere(s, n)
    pts = f.select("id", F.posexplode(F.array(*(q.struct() for q in p))).alias("pos", "q"))
    v = pts.select((F.col("id") * 4 + F.col("pos") + 1).alias("handle"), "q.x", "q.y", "q.z")
    e = f.select(model.handle(model.QUAD, F.col("id") + 1).alias("handle"), F.lit(model.QUAD).alias("etype"), F.array(*(F.col("id") * 4 + k + 1 for k in range(4))).alias("conn"))
    return model.Mesh(v, e)
