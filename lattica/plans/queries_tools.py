"""Registered queries: trees, target metrics, further quality, command-line tools."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import cli, model
from ..functions import quality, targets
from ..functions.geometry import V
from ..operators import measures, spatial, topology, trees
from ..operators.fixpoint import store
from ..sources import files
from . import tables as t
from .queries_files import INC, _back, _folder
from .queries_geometry import E3, PTS, T3, T4, TETQ, TRIQ, cross2, d2, det, micro, points, ratio, tets, tris, u

QUERIES, ORACLE = {}, {}


def H():
    return F.col("handle")


def add(name, run, sql=None):
    QUERIES[name] = run
    if sql:
        ORACLE[name] = sql


# trees ------------------------------------------------------------------------------------
_boxes = lambda s: spatial.bounds(t.hex_mesh(s, 4), 3)
_plane = lambda s: trees.plane_tree(_boxes(s))
_volume = lambda s: trees.volume_tree(_boxes(s))
HEX4 = f"WITH {t.hex_sql(4)}"
LEAF = "i, j // 2, k // 2"
add("p02_plane_tree", lambda s, d: _plane(s).members.groupBy("node").agg(F.count("*").alias("n"), F.min("handle").alias("first")).select("n", "first"), f"{HEX4} SELECT count(*) AS n, min(handle) AS first FROM bh GROUP BY {LEAF}")
add("p02_info", lambda s, d: _plane(s).info().select(*(F.col(c).cast("long").alias(c) for c in ("nodes", "leaves", "low", "high", "members", "largest"))), "SELECT 31::BIGINT AS nodes, 16::BIGINT AS leaves, 4::BIGINT AS low, 4::BIGINT AS high, 64::BIGINT AS members, 4::BIGINT AS largest")
add("p02_straddling", lambda s, d: trees.plane_tree(spatial.bounds(t.hex_mesh(s, 3), 3), 27 - 1, 1).members.groupBy("node").agg(F.count("*").alias("n")), "SELECT * FROM (VALUES (2::BIGINT, 18::BIGINT), (3, 18)) v(node, n)")
add("p02_median_planes", lambda s, d: trees.plane_tree(spatial.bounds(t.orders_mesh(s, d), 1), 50, 12, "median").members.select("handle").distinct(), t.ORDERS_SQL + "SELECT handle FROM elem WHERE etype = 1")
add("p03_leaf_of_points", lambda s, d: _leaf_boxes(s, d), f"WITH {PTS} SELECT pid, (ceil(x) - 1)::BIGINT AS i, ((ceil(y / 2) - 1) * 2)::BIGINT AS j, ((ceil(z / 2) - 1) * 2)::BIGINT AS k FROM pts WHERE x > 0 AND x <= 4 AND y > 0 AND y <= 4 AND z > 0 AND z <= 4")
add("p08_siblings", lambda s, d: _plane(s).parent(), "SELECT n AS node, n // 2 AS parent, CASE WHEN n % 2 = 0 THEN n + 1 ELSE n - 1 END AS sibling FROM range(2, 32) r(n)")
add("p08_volumes", lambda s, d: (v := _plane(s)).volume().join(v.nodes.select("node", "depth"), "node").select("node", micro(F.col("volume")).alias("volume")), "SELECT n AS node, (64000000 // (1 << floor(log2(n))::BIGINT))::BIGINT AS volume FROM range(1, 32) r(n)")
add("p08_neighbours", lambda s, d: _plane(s).neighbours().groupBy("axis").agg(F.count("*").alias("n")), "SELECT * FROM (VALUES ('x', 24::BIGINT), ('y', 16), ('z', 16)) v(axis, n)")
add("p08_merged", lambda s, d: _plane(s).merged(5).info().select(*(F.col(c).cast("long").alias(c) for c in ("nodes", "leaves", "low", "high", "members", "largest"))), "SELECT 25::BIGINT AS nodes, 13::BIGINT AS leaves, 2::BIGINT AS low, 4::BIGINT AS high, 64::BIGINT AS members, 16::BIGINT AS largest")
add("p09_volume_tree", lambda s, d: _volume(s).members.groupBy("node").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("leaves")), "SELECT 4::BIGINT AS n, 16::BIGINT AS leaves")
add("p09_point_search", lambda s, d: _volume(s).search(points(s, d)), f"{HEX4}, {PTS} SELECT pid, handle FROM pts p JOIN bh b ON p.x BETWEEN b.i AND b.i + 1 AND p.y BETWEEN b.j AND b.j + 1 AND p.z BETWEEN b.k AND b.k + 1")
add("p09_distance_search", lambda s, d: _near_members(s, d), f"{HEX4}, {PTS} SELECT pid, count(*) AS n FROM pts p JOIN bh b ON greatest(b.i - x, x - b.i - 1, 0)**2 + greatest(b.j - y, y - b.j - 1, 0)**2 + greatest(b.k - z, z - b.k - 1, 0)**2 <= 0.25 GROUP BY 1")
_space = trees.SpaceTree({}).split(1, (1.0, 1.0, 1.0, -6.0)).split(2, (1.0, -1.0, 0.0, 0.0)).split(3, (0.0, 0.0, 1.0, -2.0)).split(5, (0.0, 1.0, 0.0, -1.0))
CASE = "CASE WHEN x + y + z - 6 < 0 THEN CASE WHEN x - y < 0 THEN 4 ELSE CASE WHEN y - 1 < 0 THEN 10 ELSE 11 END END ELSE CASE WHEN z - 2 < 0 THEN 6 ELSE 7 END END"
add("p10_leaf_of_points", lambda s, d: points(s, d).select("pid", _space.leaf_of(F.col("x"), F.col("y"), F.col("z")).alias("leaf")), f"WITH {PTS} SELECT pid, ({CASE})::BIGINT AS leaf FROM pts")
add("p10_merged", lambda s, d: points(s, d).select("pid", _space.merge(2).leaf_of(F.col("x"), F.col("y"), F.col("z")).alias("leaf")), f"WITH {PTS} SELECT pid, (CASE WHEN x + y + z - 6 < 0 THEN 2 ELSE CASE WHEN z - 2 < 0 THEN 6 ELSE 7 END END)::BIGINT AS leaf FROM pts")
add("p10_leaves", lambda s, d: s.createDataFrame([(n,) for n in _space.leaves()], "leaf long"), "SELECT unnest([4, 6, 7, 10, 11])::BIGINT AS leaf")
add("p10_ray", lambda s, d: points(s, d).select("pid", F.size(trees.SpaceTree({}).split(1, (0.0, 0.0, 1.0, -9.0)).cuts((F.col("x"), F.col("y"), F.col("z")), (F.lit(0.0), F.lit(0.0), F.lit(1.0)))).cast("long").alias("n")), f"WITH {PTS} SELECT pid, (z < 9)::BIGINT AS n FROM pts")
add("p11_oriented_tree", lambda s, d: _oriented(s), "SELECT 4::BIGINT AS nodes, 60::BIGINT AS members, true AS tight")
add("p13_located_parts", lambda s, d: _located_parts(s, d), f"WITH {PTS} SELECT pid % 4 AS part, count(*) AS n FROM pts WHERE x BETWEEN 0 AND 4 AND y BETWEEN 0 AND 4 AND z BETWEEN 0 AND 4 GROUP BY 1")


def _leaf_boxes(s, d):
    tree = _plane(s)
    low = tree.leaves().select("node", *(F.col(f"{c}0").cast("long").alias(n) for c, n in zip("xyz", "ijk")))
    return tree.leaf_of(points(s, d)).join(low, "node").select("pid", "i", "j", "k")


def _near_members(s, d):
    tree, p = _volume(s), points(s, d)
    met = tree.near(p, 0.5).join(p, "pid").join(tree.members, "node").join(tree.boxes, "handle")
    far = sum(F.pow(F.greatest(F.col(f"{c}0") - F.col(c), F.col(c) - F.col(f"{c}1"), F.lit(0.0)), 2) for c in "xyz")
    return met.filter(far <= 0.25).select("pid", "handle").distinct().groupBy("pid").agg(F.count("*").alias("n"))


def _oriented(s):
    """A turned block of points: two splits give four boxes, together no larger than the whole one."""
    a, b, turn = F.col("id") % 12, F.floor(F.col("id") / 12), F.lit(0.5)
    p = s.range(60).select(F.col("id").alias("handle"), (F.cos(turn) * a - F.sin(turn) * b).alias("x"), (F.sin(turn) * a + F.cos(turn) * b).alias("y"), F.lit(0.0).alias("z"))
    p = store(s, p)
    leaf = trees.oriented_tree(p, 2)
    size = lambda groups: topology.oriented_boxes(p.join(groups, "handle").select(F.col("node").alias("group"), *"xyz")).agg(F.sum(F.col("l0") * F.col("l1")).alias("a")).first()["a"]
    whole = size(p.select("handle", F.lit(1).cast("long").alias("node")))
    return leaf.agg(F.countDistinct("node").alias("nodes"), F.count("*").alias("members")).withColumn("tight", F.lit(bool(size(leaf) < whole)))


def _located_parts(s, d):
    p = points(s, d).withColumn("part", F.col("pid") % 4)
    return spatial.locate_in_hexes(p.drop("part"), t.hex_mesh(s, 4)).join(p.select("pid", "part"), "pid").groupBy("part").agg(F.count("*").alias("n"))


# quality ------------------------------------------------------------------------------------
def _unit(corners, etype):
    """Boxes, cut or pointed: nineteen solids of one type with corners ``(x, y, top)``, their height the id."""

    def make(s):
        cells, v = s.range(1, 20), None
        n = len(corners)
        for k, (x, y, top) in enumerate(corners):
            part = cells.select((F.col("id") * n + k).alias("handle"), F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"), (F.col("id") * top).cast("double").alias("z"))
            v = part if v is None else v.unionByName(part)
        return model.Mesh(v, cells.select(model.handle(etype, F.col("id")).alias("handle"), F.lit(etype).alias("etype"), F.array(*(F.col("id") * n + k for k in range(n))).alias("conn")))

    return make


_pyramids = _unit(((0, 0, 0), (2, 0, 0), (2, 3, 0), (0, 3, 0), (1, 1, 1)), model.PYRAMID)
_knives = _unit(((0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1)), model.KNIFE)
add("v06_pyramid_volume", lambda s, d: measures.quality_of(_pyramids(s), model.PYRAMID, ["volume"]).select("handle", micro(F.col("volume")).alias("volume")), f"SELECT {model.PYRAMID << 56} + i AS handle, {u('i * 2.0')} AS volume FROM range(1, 20) r(i)")
_kn = [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1)]
_det3 = lambda a, b, c, o: sum((_kn[a][i] - _kn[o][i]) * ((_kn[b][j] - _kn[o][j]) * (_kn[c][k] - _kn[o][k]) - (_kn[b][k] - _kn[o][k]) * (_kn[c][j] - _kn[o][j])) for i, j, k in ((0, 1, 2), (1, 2, 0), (2, 0, 1)))
_knife = sum(_det3(b, c, e, a) for a, b, c, e in ((0, 1, 3, 4), (1, 5, 3, 4), (1, 2, 3, 5), (3, 2, 6, 5))) / 6
add("v06_knife_volume", lambda s, d: measures.quality_of(_knives(s), model.KNIFE, ["volume"]).select("handle", micro(F.col("volume")).alias("volume")), f"SELECT {model.KNIFE << 56} + i AS handle, {u(f'i * {_knife}::DOUBLE')} AS volume FROM range(1, 20) r(i)")
_L = [f"sqrt({e})" for e in E3]
_AREA2 = f"sqrt({cross2(1, 2, 0)})"
_ANG = [f"degrees(acos(greatest(-1, least(1, ({p} + {q} - {r}) / (2 * sqrt({p}) * sqrt({q}))))))" for p, q, r in ((E3[0], E3[2], E3[1]), (E3[0], E3[1], E3[2]), (E3[1], E3[2], E3[0]))]
_COND = f"(({E3[0]} + {E3[2]} - ({E3[0]} + {E3[2]} - {E3[1]}) / 2) / ({_AREA2} * sqrt(3.0)))"
_REL = f"pow(least(({_AREA2} / 2) / 4.0, 4.0 / ({_AREA2} / 2)), 2)"
_TRI = {
    "edge_ratio": ratio(E3), "aspect_ratio": f"greatest({', '.join(_L)}) * ({' + '.join(_L)}) / (2 * sqrt(3.0) * {_AREA2})",
    "radius_ratio": f"0.25 * {' * '.join(_L)} * ({' + '.join(_L)}) / ({_AREA2} * {_AREA2})", "aspect_frobenius": f"({' + '.join(E3)}) / (2 * sqrt(3.0) * {_AREA2})",
    "area": f"{_AREA2} / 2", "minimum_angle": f"least({', '.join(_ANG)})", "maximum_angle": f"greatest({', '.join(_ANG)})", "condition": _COND,
    "scaled_jacobian": f"2 / sqrt(3.0) * {_AREA2} / greatest({_L[0]}*{_L[1]}, {_L[1]}*{_L[2]}, {_L[2]}*{_L[0]})", "shape": f"1 / {_COND}", "relative_size": _REL, "shape_and_size": f"{_REL} / {_COND}",
}
add("v02_tri_every", lambda s, d: measures.quality_of(tris(s), model.TRI, quality.available(model.TRI), 4.0).select("handle", *(micro(F.col(c)).alias(c) for c in quality.available(model.TRI))), f"{TRIQ}{T3} SELECT handle, {', '.join(f'{u(_TRI[n])} AS {n}' for n in quality.available(model.TRI))} FROM pc")

# target metrics of tetrahedra, written out for SQL entry by entry
_W = targets.inverse(targets.REGULAR)
_A = [[f"({c}{j}-{c}0)" for j in (1, 2, 3)] for c in "xyz"]
_T = [[f"({' + '.join(f'{_A[i][k]}*({_W[k][j]!r})' for k in range(3))})" for j in range(3)] for i in range(3)]
_TS = ", ".join(f"{_T[i][j]} AS t{i}{j}" for i in range(3) for j in range(3))
_D = "(t00*(t11*t22-t12*t21) - t01*(t10*t22-t12*t20) + t02*(t10*t21-t11*t20))"
_S = " + ".join(f"t{i}{j}*t{i}{j}" for i in range(3) for j in range(3))
_ADJ = " + ".join(f"(t{(i+1)%3}{(j+1)%3}*t{(i+2)%3}{(j+2)%3} - t{(i+1)%3}{(j+2)%3}*t{(i+2)%3}{(j+1)%3})**2" for i in range(3) for j in range(3))
_I = " + ".join(f"(t{i}{j}{'-1' if i == j else ''})**2" for i in range(3) for j in range(3))
_TM = {
    "size": "(d-1)**2", "size_barrier": "d + 1/d - 2", "shape": "pow(s, 1.5) - 3*sqrt(3.0)*d", "shape_barrier": "pow(sqrt(s)/sqrt(3.0), 3)/d - 1", "shape_inverse_barrier": "s*a/(9*d*d) - 1",
    "shape_orient": "sqrt(s) - tr/sqrt(3.0)", "shape_orient_barrier": "(sqrt(s) - tr/sqrt(3.0))/(2*d)", "shape_size_barrier": "pow(s, 1.5) - 3*sqrt(3.0)*ln(d) - 3*sqrt(3.0)", "shape_size_orient": "e", "shape_size_orient_barrier": "e/(2*d)", "untangle": "(abs(d) - d)/2",
}
_EM = {"mean_ratio": "3*pow(d, 2.0/3)/s", "inverse_mean_ratio": "s/(3*pow(d, 2.0/3))", "condition_number": "sqrt(s*a)/(3*d)", "untangle_beta": "(abs(d-0.001) - (d-0.001))/2"}
_TSQL = f"{TETQ}{T4}, tm AS (SELECT *, {_TS} FROM pc), q AS (SELECT *, {_D} AS d, {_S} AS s, {_ADJ} AS a, {_I} AS e, t00+t11+t22 AS tr FROM tm)"
_edges6 = [d2(a, b) for a, b in ((0, 1), (1, 2), (2, 0), (0, 3), (1, 3), (2, 3))]


def _tet_metrics(s, table, more=()):
    """The entries of T first, in a stored table, so that every metric is a short expression of them."""
    p = [V.at(F.col("points"), i) for i in range(4)]
    m = targets.relative(p)
    rows = store(s, measures.corner_points(tets(s), etype=model.TET).select("handle", "points", *(m[i][j].alias(f"t{i}{j}") for i in range(3) for j in range(3))))
    held = [[F.col(f"t{i}{j}") for j in range(3)] for i in range(3)]
    return rows.select("handle", *(micro(f(held)).alias(n) for n, f in table.items()), *(micro(f(p)).alias(n) for n, f in more))


add("z02_target_metrics", lambda s, d: _tet_metrics(s, targets.TARGET), f"{_TSQL} SELECT handle, {', '.join(f'{u(_TM[n])} AS {n}' for n in targets.TARGET)} FROM q")
add("z01_element_metrics", lambda s, d: _tet_metrics(s, targets.ELEMENT, (("aspect_ratio_gamma", targets.aspect_ratio_gamma), ("local_size", targets.local_size))), f"{_TSQL} SELECT handle, {', '.join(f'{u(_EM[n])} AS {n}' for n in targets.ELEMENT)}, {u(f'pow(({' + '.join(_edges6)})/6, 1.5) / ({det(1, 2, 3, 0)} * sqrt(2.0))')} AS aspect_ratio_gamma, 1000000::BIGINT AS local_size FROM q")
add("z01_combined", lambda s, d: _combined(s), f"{_TSQL} SELECT handle, {u(f'2 * ({_EM['mean_ratio']}) + pow({_EM['condition_number']}, 2) * ({_EM['mean_ratio']})')} AS value FROM q")
add("z03_objectives", lambda s, d: _objectives(s), f"{_TSQL}, m AS (SELECT {_EM['mean_ratio']} AS m FROM q) SELECT {u('sum(m*m)')} AS lp, {u('sqrt(avg(m*m))')} AS pmean, {u('max(m)')} AS \"max\", {u('max(abs(m))')} AS linf, {u('stddev_pop(m)')} AS deviation, {u('var_pop(m)')} AS variance FROM m")


def _ratios(s):
    p = [V.at(F.col("points"), i) for i in range(4)]
    m = targets.relative(p)
    return measures.corner_points(tets(s), etype=model.TET).select("handle", targets.ELEMENT["mean_ratio"](m).alias("m"), targets.ELEMENT["condition_number"](m).alias("c"))


def _combined(s):
    m, c = F.col("m"), F.col("c")
    return _ratios(s).select("handle", micro(targets.added(targets.scaled(m, 2.0), targets.multiplied(targets.powered(c, 2), m))).alias("value"))


def _objectives(s):
    return _ratios(s).agg(*(targets.objective(k, F.col("m")).alias(k) for k in ("lp", "pmean", "max", "linf", "deviation", "variance"))).select(*(micro(F.col(k)).alias(k) for k in ("lp", "pmean", "max", "linf", "deviation", "variance")))


# tools ---------------------------------------------------------------------------------------
def _quads_file(s):
    uri = f"{_folder(s)}/mesh.vtk"
    files.save_vtk(t.quad_mesh(s, 8, True), uri)
    return uri


def _made(s, command, suffix, *more, source=None):
    """What a command writes, read back."""
    given = source or _quads_file(s)
    out = f"{given.rsplit('/', 1)[0]}/out.{suffix}"
    cli.run(s, [command, given, out, *more])
    return cli.read(s, out)


def _hex_file(s):
    uri = f"{_folder(s)}/mesh.vtk"
    files.save_vtk(t.hex_mesh(s, 4), uri)
    return uri


add("f26_convert", lambda s, d: _back(_made(s, "convert", "smf")), f"WITH {t.quad_sql(8, True)} " + INC.format(cells="qh", points="qv"))
add("f26_skin", lambda s, d: _made(s, "skin", "vtk", source=_hex_file(s)).elements.groupBy("etype").agg(F.count("*").alias("n")).select(F.col("etype").cast("long"), "n"), "SELECT 3::BIGINT AS etype, 96::BIGINT AS n")
add("f26_size", lambda s, d: cli.run(s, ["size", _hex_file(s)]).select("type", "n", micro(F.col("total")).alias("total")), "SELECT 'HEX' AS type, 64::BIGINT AS n, 64000000::BIGINT AS total")
add("f26_depth", lambda s, d: cli.run(s, ["depth", _hex_file(s)]).select(F.col("depth").cast("long"), "n"), "SELECT * FROM (VALUES (0::BIGINT, 56::BIGINT), (1, 8)) v(depth, n)")
add("f26_quality", lambda s, d: cli.run(s, ["check-quality", _hex_file(s), "--metric", "volume", "--metric", "stretch"]).select("type", "metric", "n", micro(F.col("low")).alias("low"), micro(F.col("high")).alias("high")), "SELECT * FROM (VALUES ('HEX', 'stretch', 64::BIGINT, 1000000::BIGINT, 1000000::BIGINT), ('HEX', 'volume', 64, 1000000, 1000000)) v(type, metric, n, low, high)")
add("f26_merge", lambda s, d: _made(s, "merge", "vtk", "--tolerance", "0.001", source=_doubled(s)).vertices.agg(F.count("*").alias("n")), "SELECT 81::BIGINT AS n")
add("f26_partition", lambda s, d: cli.run(s, ["partition", _hex_file(s), f"{_folder(s)}/out.vtk", "5", "--method", "share"]).select("part", "n"), "SELECT * FROM (VALUES (0::BIGINT, 13::BIGINT), (1, 13), (2, 13), (3, 13), (4, 12)) v(part, n)")
add("f26_refine", lambda s, d: _made(s, "refine", "vtk", "--degree", "2", source=_hex_file(s)).elements.agg(F.count("*").alias("n")), "SELECT 512::BIGINT AS n")
add("f26_second_order", lambda s, d: _made(s, "second-order", "vtk", source=_hex_file(s)).elements.select(F.size("conn").cast("long").alias("nodes")).distinct(), "SELECT 20::BIGINT AS nodes")
add("f26_compare", lambda s, d: cli.run(s, ["compare", _quads_file(s), _moved(s)]).select("what", "differences"), "SELECT 'vertices' AS what, 9::BIGINT AS differences")
add("f26_transfer_parts", lambda s, d: _transferred(s), "SELECT * FROM (VALUES (0::BIGINT, 256::BIGINT), (1, 256)) v(part, n)")
add("x08_remap_tool", lambda s, d: _remapped(s), "SELECT 64::BIGINT AS pieces, 16::BIGINT AS sources, 64::BIGINT AS targets, 64000000::BIGINT AS area")


def _doubled(s):
    """The grid with vertices of its own for every square."""
    uri = f"{_folder(s)}/mesh.vtk"
    m = t.quad_mesh(s, 8)
    inc = m.incidence().join(m.vertices.withColumnRenamed("handle", "vertex"), "vertex").withColumn("new", (model.id_of(F.col("elem")) - 1) * 4 + F.col("pos") + 1)
    conn = inc.groupBy(F.col("elem").alias("handle")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "new"))), lambda x: x["new"]).alias("conn"))
    files.save_vtk(model.Mesh(inc.select(F.col("new").alias("handle"), *"xyz"), conn.select("handle", F.lit(model.QUAD).alias("etype"), "conn")), uri)
    return uri


def _moved(s):
    uri = f"{_folder(s)}/mesh.vtk"
    m = t.quad_mesh(s, 8, True)
    files.save_vtk(m.with_(vertices=m.vertices.withColumn("x", F.when(F.col("handle") <= 9, F.col("x") + 0.5).otherwise(F.col("x")))), uri)
    return uri


def _transferred(s):
    one, two = _hex_file(s), f"{_folder(s)}/mesh.vtk"
    m = t.hex_mesh(s, 8)
    files.save_vtk(m.with_(vertices=m.vertices.select("handle", *((F.col(c) / 2).alias(c) for c in "xyz"))), two)
    parts, out = f"{one.rsplit('/', 1)[0]}/parts.vtk", f"{one.rsplit('/', 1)[0]}/out.vtk"
    cli.run(s, ["partition", one, parts, "2", "--method", "share"])
    cli.run(s, ["transfer-parts", parts, two, out])
    return cli.read(s, out).tag("PARTITION").values.groupBy(F.col("value").cast("long").alias("part")).agg(F.count("*").alias("n"))


def _remapped(s):
    one, two = f"{_folder(s)}/one.vtk", f"{_folder(s)}/two.vtk"
    files.save_vtk(t.quad_mesh(s, 8), two)
    m = t.quad_mesh(s, 4)
    files.save_vtk(m.with_(vertices=m.vertices.select("handle", *((F.col(c) * 2).alias(c) for c in "xyz"))), one)
    return cli.run(s, ["remap", one, two]).select("pieces", "sources", "targets", micro(F.col("area")).alias("area"))



# more of refinement, spheres and surfaces -------------------------------------------------------
add("k22_refine_where", lambda s, d: _refined_where(s), "SELECT 145::BIGINT AS vertices, 256::BIGINT AS elements, 64000000::BIGINT AS area, 0::BIGINT AS odd_edges")
add("k26_spectral_fine", lambda s, d: _spectral_counts(s), f"SELECT 343::BIGINT AS vertices, 216::BIGINT AS elements, 7::BIGINT AS planes, {u('(1 - 1/sqrt(5.0)) / 2')} AS second")
add("k26_spectral_coarse", lambda s, d: _spectral_back(s).elements.select("handle", F.array_join("conn", ",").alias("conn")), f"WITH {t.hex_sql(2)} SELECT handle, array_to_string(conn, ',') AS conn FROM bh")
add("k25_fitted_plane", lambda s, d: measures.fitted_normals(_tilted(s)).select("handle", *(micro(F.col(c)).alias(c) for c in "xyz")), f"WITH {t.quad_sql(8)} SELECT handle, {u('-2 / sqrt(6.0)')} AS x, {u('1 / sqrt(6.0)')} AS y, {u('1 / sqrt(6.0)')} AS z FROM qv")
add("k25_fitted_sphere", lambda s, d: _fitted_sphere(s), "SELECT true AS normals, true AS curvature")
add("v07_distortion_hex", lambda s, d: measures.distortion(t.hex_mesh(s, 4), model.HEX).select("handle", micro(F.col("distortion")).alias("distortion")), f"WITH {t.hex_sql(4)} SELECT handle, 1000000::BIGINT AS distortion FROM bh")
add("v07_distortion_quad", lambda s, d: measures.distortion(_tapered(s), model.QUAD).select("handle", micro(F.col("distortion")).alias("distortion")), f"WITH {t.quad_sql(8)} SELECT handle, {u('(1 + 0.1*(j + 0.5 - 0.5/sqrt(3.0))) / (1 + 0.1*(j + 0.5))')} AS distortion FROM qh")
_ARC = "WITH " + t.points_sql(1.0, 0.0) + ", q AS (SELECT pid, atan2(y, x) AS lon FROM pts)"
add("g13_arc_crossing", lambda s, d: _arcs(s, d), f"{_ARC} SELECT pid, {u('cos(lon)')} AS x, {u('sin(lon)')} AS y, 0::BIGINT AS z FROM q WHERE abs(lon) <= 1")
add("g13_latitude", lambda s, d: _latitudes(s, d), f"{_ARC} SELECT pid, 1::BIGINT AS n, {u('sqrt(0.91)*cos(lon)')} AS x, {u('sqrt(0.91)*sin(lon)')} AS y FROM q")
add("g13_orientation", lambda s, d: _reoriented(s), "SELECT true AS before, true AS after, 96::BIGINT AS n")
add("g13_collapsed_quads", lambda s, d: _collapsed(s), "SELECT * FROM (VALUES (1::BIGINT, 2::BIGINT, '1,2,3'), (2, 3, '1,2,3,4'), (3, 2, '2,3,4')) v(id, etype, conn)")
add("g13_convex_parts", lambda s, d: _convex(s), "SELECT * FROM (VALUES (1::BIGINT, '1,2,3,4'), (2, '4,1,2'), (2, '4,2,3')) v(id, conn)")


def _refined_where(s):
    from ..operators import mutation

    length = sum((F.col(f"a{c}") - F.col(f"b{c}")) ** 2 for c in "xyz")
    m = mutation.refine_where(t.tri_mesh(s, 8), length > 1.5)
    from ..operators import adjacency

    odd = adjacency.facets(m, 2).groupBy("key").agg(F.count("*").alias("n")).filter("n > 2").count()
    area = measures.measures(m, 2).agg(F.count("*").alias("elements"), micro(F.sum("measure")).alias("area"))
    return area.select(F.lit(m.vertices.count()).cast("long").alias("vertices"), "elements", "area", F.lit(odd).cast("long").alias("odd_edges"))


def _spectral_counts(s):
    from ..operators import mutation

    fine, _ = mutation.spectral_fine(t.hex_mesh(s, 2), model.HEX, 3)
    x = micro(F.col("x"))
    planes = fine.vertices.agg(F.countDistinct(x).alias("planes"), F.min(F.when(F.col("x") > 1e-9, x)).alias("second"))
    return planes.select(F.lit(fine.vertices.count()).cast("long").alias("vertices"), F.lit(fine.elements.count()).cast("long").alias("elements"), "planes", "second")


def _spectral_back(s):
    from ..operators import mutation

    fine, nodes = mutation.spectral_fine(t.hex_mesh(s, 2), model.HEX, 3)
    return mutation.spectral_coarse(fine, nodes, model.HEX, 3)


def _tilted(s):
    m = t.quad_mesh(s, 8)
    return m.with_(vertices=m.vertices.select("handle", "x", "y", (2 * F.col("x") - F.col("y")).alias("z")))


def _tapered(s):
    m = t.quad_mesh(s, 8)
    return m.with_(vertices=m.vertices.select("handle", (F.col("x") * (1 + 0.1 * F.col("y"))).alias("x"), "y", "z"))


def _fitted_sphere(s):
    """Normals of a fine sphere are its radii, and its mean curvature is 1 (bent away from the normals)."""
    from ..operators import mutation
    from .queries_geometry import _sphere_mesh

    m = _sphere_mesh(s, 12)
    pairs = mutation.merge_map(m.vertices, 1e-6)
    m = mutation.remap(m, store(s, pairs))
    m = m.with_(vertices=store(s, m.vertices), elements=store(s, m.elements))
    got = measures.fitted_normals(m, 2, 2).join(m.vertices.select("handle", *(F.col(c).alias(f"p{c}") for c in "xyz")), "handle")
    dot = sum(F.col(c) * F.col(f"p{c}") for c in "xyz")
    return got.agg((F.min(F.abs(dot)) > 0.9999).alias("normals"), (F.max(F.abs(F.abs("mean_curvature") - 1)) < 0.03).alias("curvature"))


def _longitude(s, d):
    return t.points(s, d, 1.0, 0.0).select("pid", F.atan2("y", "x").alias("lon"))


def _at(lon, lat):
    return V(F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat))


def _arcs(s, d):
    from ..functions import sphere

    lon, one, zero, half = F.col("lon"), F.lit(1.0), F.lit(0.0), F.lit(0.5)
    q = sphere.arc_crossing(_at(-one, zero), _at(one, zero), _at(lon, -half), _at(lon, half))
    return _longitude(s, d).select("pid", q.alias("q")).filter("q IS NOT NULL").select("pid", *(micro(F.col(f"q.{c}")).alias(c) for c in "xyz"))


def _latitudes(s, d):
    from ..functions import sphere

    lon = F.col("lon")
    q = sphere.latitude_crossings(_at(lon, F.lit(0.0)), _at(lon, F.lit(1.0)), 0.3)
    return _longitude(s, d).select("pid", q.alias("q")).select("pid", F.size("q").cast("long").alias("n"), *(micro(F.element_at("q", 1)[c]).alias(c) for c in "xy"))


def _reoriented(s):
    from ..functions import sphere
    from .queries_geometry import _sphere_mesh

    m = _sphere_mesh(s, 4)
    odd = model.id_of(H()) % 2 == 1
    p = measures.corner_points(m, 2).join(m.elements.select("handle", "conn"), "handle")
    p = p.withColumn("points", F.when(odd, F.reverse("points")).otherwise(F.col("points"))).withColumn("conn", F.when(odd, F.reverse("conn")).otherwise(F.col("conn")))
    right = F.when(odd, ~sphere.is_positive(F.col("points"))).otherwise(sphere.is_positive(F.col("points")))
    done = sphere.positive(F.col("conn"), F.col("points"))
    plain = m.elements.select("handle", F.col("conn").alias("old"))
    ring = lambda c: F.concat_ws(",", F.concat(F.slice(c, F.array_position(c, F.array_min(c)).cast("int"), 4), F.slice(c, F.lit(1), F.array_position(c, F.array_min(c)).cast("int") - 1)))
    return p.select("handle", right.alias("r"), done.alias("done")).join(plain, "handle").agg(F.bool_and("r").alias("before"), F.bool_and(ring(F.col("done")) == ring(F.col("old"))).alias("after"), F.count("*").alias("n"))


def _collapsed(s):
    from ..functions import sphere

    rows = s.createDataFrame([(1, [1, 2, 3, 3]), (2, [1, 2, 3, 4]), (3, [4, 2, 3, 4])], "id long, conn array<long>")
    done = sphere.without_repeats(F.col("conn"))
    return rows.select("id", sphere.type_of_size(done).cast("long").alias("etype"), F.array_join(done, ",").alias("conn"))


def _convex(s):
    from ..functions import sphere

    corner = lambda lon, lat: F.struct(*(c.alias(n) for n, c in zip("xyz", (lambda v: (v.x, v.y, v.z))(_at(F.lit(float(lon)), F.lit(float(lat)))))))
    whole, bent = [(0, 0), (0.4, 0), (0.4, 0.4), (0, 0.4)], [(0, 0), (0.4, 0), (0.4, 0.4), (0.25, 0.15)]
    rows = s.range(1, 3).select(F.col("id"), F.when(F.col("id") == 1, F.array(*(corner(*p) for p in whole))).otherwise(F.array(*(corner(*p) for p in bent))).alias("points"), F.array(*(F.lit(i).cast("long") for i in (1, 2, 3, 4))).alias("conn"))
    return rows.select("id", F.explode(sphere.convex_parts(F.col("conn"), F.col("points"))).alias("c")).select("id", F.array_join("c", ",").alias("conn"))
