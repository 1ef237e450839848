"""Registered queries: evaluators, interpolation of higher order, trilinear maps, plane kernels, reader helpers."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from .. import model
from ..functions import plane
from ..operators import fields, measures, mutation, remap, spatial
from ..operators.evaluator import Evaluator, spherical
from . import tables as t
from .queries_geometry import PTS, QUADQ, _sphere_mesh, _src, _tgt, corners, cross2, linear, micro, points, rounded, u

QUERIES, ORACLE = {}, {}


def H():
    return F.col("handle")


def add(name, run, sql=None):
    QUERIES[name] = run
    if sql:
        ORACLE[name] = sql


inside = "x BETWEEN 0 AND 4 AND y BETWEEN 0 AND 4 AND z BETWEEN 0 AND 4"
LIN, SQUARE = "2*x - y + 0.5*z + 3", "x*x - 2*y*z + 0.25*z*z + x"
flat = lambda s, d: points(s, d).withColumn("z", F.lit(0.0))
FLAT = f"{PTS}, fl AS (SELECT pid, x, y, 0.0::DOUBLE AS z FROM pts)"
_square = lambda m: m.vertices.select(H().alias("entity"), (F.col("x") ** 2 - 2 * F.col("y") * F.col("z") + 0.25 * F.col("z") ** 2 + F.col("x")).alias("value"))
_value = lambda df: df.select("pid", micro(F.col("value")).alias("value"))


def _second_order(s):
    """Hexahedra with nodes in the middles of edges and faces and in the middle: 27 each."""
    m = t.hex_mesh(s, 4)
    fine = mutation.refine(m, model.HEX, 2)
    from ..functions.shapes import shape

    at = (shape(model.HEX, "quadratic").nodes + 1) / 2
    box = t.box(4).elements(s).select("handle", "i", "j", "k")
    wanted = box.select("handle", F.posexplode(F.array(*(F.struct(*((F.col(c) + float(x)).alias(a) for c, x, a in zip("ijk", p, "xyz"))) for p in at))).alias("pos", "p")).select("handle", "pos", "p.*")
    conn = wanted.join(fine.vertices.withColumnRenamed("handle", "v"), ["x", "y", "z"]).groupBy("handle").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda q: q["v"]).alias("conn"))
    return m.with_(vertices=fine.vertices, elements=conn.select("handle", F.lit(model.HEX).alias("etype"), "conn"))


def _spectral(s, order):
    """Nodal values of the square field on a grid of Lobatto nodes in every hexahedron."""
    from ..functions.shapes import shape

    at = (shape(model.HEX, "spectral", order).nodes + 1) / 2
    x, y, z = (lambda p: F.col("i") + float(p[0])), (lambda p: F.col("j") + float(p[1])), (lambda p: F.col("k") + float(p[2]))
    value = lambda p: x(p) * x(p) - 2 * y(p) * z(p) + 0.25 * z(p) * z(p) + x(p)
    return t.box(4).elements(s).select(H().alias("entity"), F.array(*(value(p) for p in at)).alias("value"))


ev = lambda s, m, e, **k: Evaluator(m, e, **k)
add("h01_eval_tri", lambda s, d: _value(ev(s, t.tri_mesh(s, 8), model.TRI).interpolate(flat(s, d), linear(t.tri_mesh(s, 8)))), f"WITH {FLAT} SELECT pid, {u(LIN)} AS value FROM fl WHERE x BETWEEN 0 AND 8 AND y BETWEEN 0 AND 8")
add("h01_eval_quad", lambda s, d: _value(ev(s, t.quad_mesh(s, 8), model.QUAD).interpolate(flat(s, d), linear(t.quad_mesh(s, 8)))), f"WITH {FLAT} SELECT pid, {u(LIN)} AS value FROM fl WHERE x BETWEEN 0 AND 8 AND y BETWEEN 0 AND 8")
add("h01_eval_tet", lambda s, d: _value(ev(s, t.tet_mesh(s, 4), model.TET).interpolate(points(s, d), linear(t.tet_mesh(s, 4)))), f"WITH {PTS} SELECT pid, {u(LIN)} AS value FROM pts WHERE {inside}")
add("h01_eval_hex", lambda s, d: _value(ev(s, t.hex_mesh(s, 4), model.HEX).interpolate(points(s, d), linear(t.hex_mesh(s, 4)))), f"WITH {PTS} SELECT pid, {u(LIN)} AS value FROM pts WHERE {inside}")
add("h04_quadratic_fe", lambda s, d: _value(ev(s, m := _second_order(s), model.HEX, kind="quadratic").interpolate(points(s, d), _square(m))), f"WITH {PTS} SELECT pid, {u(SQUARE)} AS value FROM pts WHERE {inside}")
add("h04_spectral", lambda s, d: _value(ev(s, t.hex_mesh(s, 4), model.HEX, kind="spectral", order=3).interpolate(points(s, d), _spectral(s, 3))), f"WITH {PTS} SELECT pid, {u(SQUARE)} AS value FROM pts WHERE {inside}")
add("h04_spherical", lambda s, d: spherical(m := _sphere_mesh(s, 8), _on_sphere(s, d), m.vertices.select(H().alias("entity"), F.lit(2.5).alias("value"))).select("pid", micro(F.col("value")).alias("value")), "SELECT vec_id::BIGINT AS pid, 2500000::BIGINT AS value FROM embeddings WHERE embedding[1]**2 + embedding[2]**2 + embedding[3]**2 > 0")
add("h01_jacobian", lambda s, d: ev(s, t.hex_mesh(s, 4), model.HEX).jacobian(_placed(s)).select(F.col("pid").alias("handle"), micro(F.col("jacobian")).alias("jacobian")), f"SELECT {9 << 56} + i AS handle, 125000::BIGINT AS jacobian FROM range(1, 65) r(i)")
add("h01_integrate_hex", lambda s, d: rounded(ev(s, t.hex_mesh(s, 4), model.HEX).integrate(linear(t.hex_mesh(s, 4))), "integral"), f"WITH {t.hex_sql(4)} SELECT handle, {u('2*(i+0.5) - (j+0.5) + 0.5*(k+0.5) + 3')} AS integral FROM bh")
add("h01_integrate_quadratic", lambda s, d: ev(s, m := _second_order(s), model.HEX, kind="quadratic").integrate(_square(m)).agg(micro(F.sum("integral")).alias("integral")), f"SELECT {u('64.0*4/3*4 - 2*4*8*8 + 0.25*64*4/3*4 + 8*4*4')} AS integral")
add("h01_integrate_tri", lambda s, d: rounded(ev(s, t.tri_mesh(s, 8), model.TRI).integrate(linear(t.tri_mesh(s, 8))), "integral"), f"WITH {t.tri_sql(8)}, c AS (SELECT handle, unnest(conn) AS v FROM qt) SELECT c.handle, {u('0.5 * avg(2*x - y + 3)')} AS integral FROM c JOIN qv ON v = qv.handle GROUP BY 1")
add("h01_integrate_tet", lambda s, d: ev(s, t.tet_mesh(s, 4), model.TET).integrate(linear(t.tet_mesh(s, 4))).agg(micro(F.sum("integral")).alias("integral")), f"SELECT {u('64 * (4 - 2 + 1 + 3.0)')} AS integral")
add("h01_normals", lambda s, d: ev(s, t.quad_mesh(s, 8), model.QUAD).normals(t.quad_mesh(s, 8).elements.select(H().alias("pid"), "handle", *(F.lit(0.25).alias(c) for c in ("xi", "eta", "zeta")))).select("pid", *(micro(F.col(c)).alias(c) for c in "xyz")), f"WITH {t.quad_sql(8)} SELECT handle AS pid, 0::BIGINT AS x, 0::BIGINT AS y, 1000000::BIGINT AS z FROM qh")
add("h01_containing_tri", lambda s, d: ev(s, t.tri_mesh(s, 8), model.TRI).containing(flat(s, d)).select("pid", F.floor((model.id_of(H()) - 1) / 2).alias("cell")), f"WITH {FLAT} SELECT pid, ceil(x)::BIGINT - 1 + 8*(ceil(y)::BIGINT - 1) AS cell FROM fl WHERE x > 0 AND x <= 8 AND y > 0 AND y <= 8")
add("h02_shape_sums", lambda s, d: _shape_sums(s), "SELECT * FROM (VALUES ('hex8', 8::BIGINT, 8000000::BIGINT), ('hex27', 27, 8000000), ('spectral_hex4', 125, 8000000), ('quad4', 4, 4000000), ('spectral_quad3', 16, 4000000), ('tri3', 3, 500000), ('tet4', 4, 166667)) v(name, nodes, integral)")
add("h03_locate_centroids", lambda s, d: fields.locate_entities(t.hex_mesh(s, 4), model.HEX, _half(s), 3).select(F.col("pid").alias("target"), F.col("handle").alias("source")), f"WITH {t.hex_sql(8)} SELECT handle AS target, {9 << 56} + 1 + i // 2 + 4 * (j // 2) + 16 * (k // 2) AS source FROM bh")
add("h03_locate_nearest", lambda s, d: fields.locate_points(t.hex_mesh(s, 4), model.HEX, points(s, d), nearest=True).select("pid", H().isNotNull().alias("found")), f"WITH {PTS} SELECT pid, true AS found FROM pts")
add("h08_data_coupler", lambda s, d: _coupled(s, d), f"WITH {PTS} SELECT pid, {u(LIN)} AS one, {u('x + y')} AS two FROM pts WHERE {inside}")
add("g07_natural_coordinates", lambda s, d: _natural(s, d), "WITH " + t.points_sql(1.0, 0.0) + f" SELECT pid, {u('x')} AS xi, {u('y')} AS eta, {u('z')} AS zeta, (greatest(abs(x), abs(y), abs(z)) <= 1) AS inside FROM pts")
_flat_sql = "WITH " + t.points_sql(1.0, 0.0)
_p = lambda s, d: t.points(s, d, 1.0, 0.0)
_xy = lambda *ps: F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ps))
add("x03_area", lambda s, d: measures.corner_points(t.quad_mesh(s, 8, True), 2).select("handle", micro(plane.area(F.col("points"))).alias("area")), f"{QUADQ}{corners('qh', 'qv', 4)} SELECT handle, {u('((x0*y1-x1*y0)+(x1*y2-x2*y1)+(x2*y3-x3*y2)+(x3*y0-x0*y3))/2')} AS area FROM pc")
add("x03_inside_convex", lambda s, d: _p(s, d).select("pid", plane.in_convex(F.col("x"), F.col("y"), _xy((-1, -1), (1, -1), (0, 1.5))).alias("inside")), f"{_flat_sql} SELECT pid, (y >= -1 - 1e-12 AND 2.5*x + y <= 1.5 + 1e-12 AND -2.5*x + y <= 1.5 + 1e-12) AS inside FROM pts")
add("x03_edge_crossings", lambda s, d: _p(s, d).select("pid", plane.crossing((F.col("x"), F.lit(-9.0)), (F.col("x"), F.lit(9.0)), (F.lit(-1.0), F.lit(0.0)), (F.lit(1.0), F.lit(2.0))).alias("q")).filter("q IS NOT NULL").select("pid", micro(F.col("q.x")).alias("x"), micro(F.col("q.y")).alias("y")), f"{_flat_sql} SELECT pid, {u('x')} AS x, {u('x + 1')} AS y FROM pts WHERE abs(x) <= 1")
add("x03_sorted_corners", lambda s, d: _turned(s), f"WITH {t.quad_sql(8)} SELECT handle, 4::BIGINT AS n, 1000000::BIGINT AS area FROM qh")
add("x03_distance", lambda s, d: _p(s, d).select("pid", micro(plane.distance((F.col("x"), F.col("y")), (F.lit(1.0), F.lit(2.0)))).alias("d")), f"{_flat_sql} SELECT pid, {u('sqrt((x-1)**2 + (y-2)**2)')} AS d FROM pts")
_OV = "WITH s AS (SELECT %d + 1 + i + 6*j AS h, i*2 AS x, j*2 AS y FROM range(6) a(i), range(6) b(j)), g AS (SELECT %d + 1 + i + 4*j AS h, i*3 AS x, j*3 AS y FROM range(4) a(i), range(4) b(j)), o AS (SELECT s.h AS source, g.h AS target, (least(s.x+2, g.x+3) - greatest(s.x, g.x)) * (least(s.y+2, g.y+3) - greatest(s.y, g.y)) AS area FROM s JOIN g ON s.x < g.x+3 AND g.x < s.x+2 AND s.y < g.y+3 AND g.y < s.y+2)" % (3 << 56, 3 << 56)
add("x04_update_tracer", lambda s, d: rounded(remap.update_tracer(remap.overlap_in_plane(_src(s), _tgt(s)), _src(s).elements.select(H().alias("entity"), (model.id_of(H()) % 5).cast("double").alias("value")), _tgt(s).elements.select("handle", F.lit(9.0).alias("area"))), "value"), f"{_OV} SELECT target AS handle, {u(f'sum(area * ((source & {model.ID_MASK}) % 5)) / 9.0')} AS value FROM o GROUP BY 1")
add("x04_covering_set", lambda s, d: remap.covering(_src(s), _tgt(s).elements.select(H().alias("handle"), (model.id_of(H()) % 2).alias("part")), _tgt(s)), f"{_OV}, bx AS (SELECT (g.h & {model.ID_MASK}) % 2 AS part, min(x) AS x0, max(x) + 3 AS x1, min(y) AS y0, max(y) + 3 AS y1 FROM g GROUP BY 1) SELECT part, s.h AS handle FROM s JOIN bx ON s.x <= x1 AND s.x + 2 >= x0 AND s.y <= y1 AND s.y + 2 >= y0")


def _on_sphere(s, d):
    p = t.points(s, d, 1.0, 0.0)
    n = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    return p.filter(n > 0).select("pid", *((F.col(c) / n).alias(c) for c in "xyz"))


def _placed(s):
    return t.hex_mesh(s, 4).elements.select(H().alias("pid"), "handle", *(F.lit(0.3).alias(c) for c in ("xi", "eta", "zeta")))


def _half(s):
    m = t.hex_mesh(s, 8)
    return m.with_(vertices=m.vertices.select("handle", *((F.col(c) / 2).alias(c) for c in "xyz")))


def _coupled(s, d):
    m = t.hex_mesh(s, 4)
    c = fields.Coupler(m, model.HEX, points(s, d))
    one = c.interpolate(linear(m)).select("pid", micro(F.col("value")).alias("one"))
    two = c.interpolate(m.vertices.select(H().alias("entity"), (F.col("x") + F.col("y")).alias("value"))).select("pid", micro(F.col("value")).alias("two"))
    return one.join(two, "pid")


def _natural(s, d):
    """Points in one sheared box that maps to the unit cube by a rotation and shifts, so that their coordinates are known."""
    m = model.mesh_from_arrays(s, [(5 + x + y, 3 + y - z, 2 * z) for x, y, z in ((-1, -1, -1), (1, -1, -1), (1, 1, -1), (-1, 1, -1), (-1, -1, 1), (1, -1, 1), (1, 1, 1), (-1, 1, 1))], [("HEX", list(range(8)))])
    moved = t.points(s, d, 1.0, 0.0).select("pid", (5 + F.col("x") + F.col("y")).alias("x"), (3 + F.col("y") - F.col("z")).alias("y"), (2 * F.col("z")).alias("z"))
    found = Evaluator(m, model.HEX).reverse(moved.withColumn("handle", F.lit((model.HEX << model.SHIFT) | 1)), 0.0 + 1e-9)
    return found.select("pid", *(micro(F.col(c)).alias(c) for c in ("xi", "eta", "zeta")), "inside")


def _turned(s):
    """Corners of quads given in a wrong order, with one twice, sorted around their middle again."""
    p = measures.corner_points(t.quad_mesh(s, 8), 2)
    mixed = F.array(*(F.element_at("points", i) for i in (3, 1, 4, 1, 2)))
    done = plane.sorted_ring(mixed)
    return p.select("handle", F.size(done).cast("long").alias("n"), micro(plane.area(done)).alias("area"))


def _shape_sums(s):
    """Integrals of the sums of all weights, which are 1 everywhere."""
    from ..functions import shapes

    rows = []
    for name, etype, kind, order in (("hex8", model.HEX, "linear", 1), ("hex27", model.HEX, "quadratic", 2), ("spectral_hex4", model.HEX, "spectral", 4), ("quad4", model.QUAD, "linear", 1), ("spectral_quad3", model.QUAD, "spectral", 3), ("tri3", model.TRI, "linear", 1), ("tet4", model.TET, "linear", 1)):
        shape, (x, w) = shapes.shape(etype, kind, order), shapes.rule(etype)
        rows.append((name, len(shape.nodes), math.floor(float((w[:, None] * shape.weights(x)).sum()) * 1e6 + 0.5)))
    return s.createDataFrame(rows, "name string, nodes long, integral long")
