"""Shapes, refinement templates, clipping, searches, options, readers and tools, against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica import cli, model
from lattica.functions import shapes, targets
from lattica.functions.homogeneous import Coordinate, Transform
from lattica.model import EDGE, HEX, POLYGON, PRISM, PYRAMID, QUAD, TET, TRI, MeshError, mesh_from_arrays
from lattica.operators import mutation, ranges, remap, spatial, trees
from lattica.sources import files, text_formats
from lattica.sources.options import Options


@pytest.mark.parametrize("etype,kind,order", [(TRI, "linear", 1), (TET, "linear", 1), (QUAD, "linear", 1), (HEX, "linear", 1), (QUAD, "quadratic", 2), (HEX, "quadratic", 2), (QUAD, "spectral", 4), (HEX, "spectral", 3)])
def test_shapes(etype, kind, order):
    s = shapes.shape(etype, kind, order)
    assert np.allclose(s.weights(s.nodes), np.eye(len(s.nodes)), atol=1e-9)
    x = np.random.default_rng(1).uniform(0.05, 0.3, (20, s.dim))
    assert np.allclose(s.weights(x).sum(1), 1)
    for d in range(s.dim):
        step = np.eye(s.dim)[d] * 1e-6
        slope = (s.weights(x + step) - s.weights(x - step)) / 2e-6
        assert np.allclose(slope, s.gradient(x)[:, :, d], atol=1e-6)
    nodes = np.zeros((20, len(s.nodes), 3))
    nodes[:, :, : s.dim] = s.nodes * 2 + 1
    at = np.einsum("nk,nkc->nc", s.weights(x), nodes)
    got, rest = shapes.reverse(s, at, nodes)
    assert rest.all() and np.allclose(got, x, atol=1e-8) and s.inside(got).all()
    assert not s.inside(np.full((1, s.dim), 1.5)).any()


def test_nodes_and_rules():
    assert np.allclose(shapes.lobatto(3)[0], [-1, -(5**-0.5), 5**-0.5, 1]) and np.isclose(shapes.lobatto(4)[1].sum(), 2)
    for etype, size in ((EDGE, 2), (TRI, 1 / 2), (QUAD, 4), (TET, 1 / 6), (HEX, 8)):
        x, w = shapes.rule(etype)
        assert np.isclose(w.sum(), size)
        if etype == TET:
            assert np.isclose((w * x[:, 0] * x[:, 1]).sum(), 1 / 120)
    with pytest.raises(MeshError):
        shapes.shape(PYRAMID)


@pytest.mark.parametrize("etype,degree", [(TRI, 2), (TRI, 5), (TET, 2), (TET, 3), (QUAD, 3), (HEX, 2)])
def test_templates_fill_the_parent(etype, degree):
    weights, children = mutation._template(etype, degree)
    dim = model.DIMENSIONS[etype]
    corners = np.vstack([np.zeros(dim), np.eye(dim)]) if etype in (TRI, TET) else (np.array(shapes.CORNERS[etype]) + 1) / 2
    at = np.array([sum(w * corners[k] for k, w in own.items()) / sum(own.values()) for own in weights])
    assert len(children) == degree**dim and len({tuple(sorted(own.items())) for own in weights}) == len(weights)
    if etype in (TRI, TET):
        size = [np.linalg.det(at[list(c[1:])] - at[c[0]]) for c in children]
        assert np.allclose(size, 1 / degree**dim)
    else:
        assert all(np.allclose(at[list(c)] - at[c[0]], corners / degree) for c in children)


def plain_clip(subject, window):
    out = list(map(tuple, subject))
    for (ax, ay), (bx, by) in zip(window, np.roll(window, -1, 0)):
        got, out = out, []
        for (px, py), (qx, qy) in zip(got, got[1:] + got[:1]):
            s = (bx - ax) * (py - ay) - (by - ay) * (px - ax)
            t = (bx - ax) * (qy - ay) - (by - ay) * (qx - ax)
            if s >= 0:
                out.append((px, py))
            if s * t < 0:
                out.append((px + s / (s - t) * (qx - px), py + s / (s - t) * (qy - py)))
    return abs(sum(ax * by - bx * ay for (ax, ay), (bx, by) in zip(out, out[1:] + out[:1]))) / 2 if out else 0.0


def test_clipping_matches_one_by_one():
    rnd = np.random.default_rng(3)
    angle = np.sort(rnd.uniform(0, 2 * np.pi, (2, 200, 5)), axis=2)
    shape = np.stack([np.cos(angle), np.sin(angle)], 3) * rnd.uniform(0.3, 1.5, (2, 200, 1, 1)) + rnd.uniform(-1, 1, (2, 200, 1, 2))
    shape[0, :50, 4] = shape[0, :50, 3]  # padded
    shape[1, 150:] += 9  # apart
    got = remap.planar_areas(remap.clip(shape[0], shape[1]))
    assert np.allclose(got, [plain_clip(p, q) for p, q in zip(shape[0], shape[1])], atol=1e-9) and not got[150:].any()


def tri_rows(tris):
    return [(i, *(tuple(map(float, p)) for p in t)) for i, t in enumerate(tris)]


TRIS = "handle long, a struct<x:double,y:double,z:double>, b struct<x:double,y:double,z:double>, c struct<x:double,y:double,z:double>"


def plain_distance(p, t):
    """By the foot on the plane, if it lies inside, else by the edges."""
    a, b, c = t
    n = np.cross(b - a, c - a)
    best = np.inf
    if n @ n > 0:
        q = p - (p - a) @ n / (n @ n) * n
        if all(np.cross(v - u, q - u) @ n >= 0 for u, v in ((a, b), (b, c), (c, a))):
            best = (p - q) @ (p - q)
    for u, v in ((a, b), (b, c), (c, a)):
        s = np.clip((p - u) @ (v - u) / max((v - u) @ (v - u), 1e-300), 0, 1)
        q = u + s * (v - u)
        best = min(best, (p - q) @ (p - q))
    return best


def test_closest_triangle_and_rays_over_sizes(spark):
    rnd = np.random.default_rng(9)
    tris = [rnd.uniform(-5, 5, 3) + rnd.normal(size=(3, 3)) * rnd.choice([0.01, 0.3, 20]) for _ in range(120)]
    points = np.vstack([rnd.uniform(-6, 6, (30, 3)), rnd.uniform(-4000, 4000, (6, 3))])
    t = spark.createDataFrame(tri_rows(tris), TRIS)
    p = spark.createDataFrame([(i, *map(float, q)) for i, q in enumerate(points)], "pid long, x double, y double, z double")
    got = {r.pid: r.squared for r in spatial.closest_triangle(p, t).collect()}
    want = {i: min(plain_distance(q, x) for x in tris) for i, q in enumerate(points)}
    assert got.keys() == want.keys() and all(np.isclose(got[i], want[i], rtol=1e-7, atol=1e-12) for i in want)
    assert spatial.closest_triangle(p, t.limit(0)).count() == 0
    rays = [(i, tuple(map(float, o)), tuple(map(float, d))) for i, (o, d) in enumerate(zip(rnd.uniform(-8, 8, (40, 3)), rnd.normal(size=(40, 3))))]
    r = spark.createDataFrame(rays, "rid long, o struct<x:double,y:double,z:double>, d struct<x:double,y:double,z:double>")
    hits = {(h.rid, h.handle) for h in spatial.ray_hits(r, t).collect()}
    plain = set()
    for i, o, d in rays:
        for k, (a, b, c) in enumerate(tris):
            m = np.stack([a - b, a - c, np.array(d)], 1)
            if abs(np.linalg.det(m)) > 0:
                beta, gamma, dist = np.linalg.solve(m, a - np.array(o))
                if beta >= 0 and gamma >= 0 and beta + gamma <= 1 and dist >= 0:
                    plain.add((i, k))
    assert hits == plain and len(plain) > 20


def test_ranks_and_unknown_orders(spark):
    rows = [(random.Random(i).randint(0, 9), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, v long").repartition(7)
    got = {(r.k, r.v): r.n for r in ranges.ranked(df, ["k", "v"], "n").collect()}
    assert got == {x: i for i, x in enumerate(sorted(rows))}
    assert ranges.ranked(df.limit(0), ["k"], "n").count() == 0


def test_options():
    o = Options.parse("A;b=2;C=1-3,7;D=x,y;E=1.5;F=maybe")
    assert o.flag("a") and o.integer("B") == 2 and o.integers("c") == [1, 2, 3, 7] and o.texts("D") == ["x", "y"] and o.real("e") == 1.5
    assert o.unseen() == ["F"] and not Options.parse(None).items and Options.parse(";|A|B=1").integer("b") == 1
    for what in (lambda: o.toggle("F"), lambda: o.integer("D"), lambda: o.flag("B"), lambda: o.text("nothing"), lambda: o.choice("D", ["z"]), lambda: Options.parse("Q").done(), lambda: Options.parse("C=3-1").integers("C")):
        with pytest.raises(MeshError):
            what()


def test_homogeneous_transforms():
    turn = Transform.from_points((Coordinate(0, 0, 0), Coordinate(2, 0, 0), Coordinate(0, 3, 0)), (Coordinate(1, 1, 1), Coordinate(1, 3, 1), Coordinate(1, 1, 4)))
    assert turn(Coordinate(2, 3, 0)) == Coordinate(1, 3, 4) and turn.inverse()(turn(Coordinate(4, 5, 6))) == Coordinate(4, 5, 6)
    a, b = Coordinate(1, 2, 3), Coordinate(0, 1, 0)
    assert a + b == Coordinate(1, 3, 3) and (a - b).dot(b) == 1 and a.cross(b) == Coordinate(-3, 0, 1) and -b == Coordinate(0, -1, 0) and b.below(a)


def test_space_tree_shape():
    t = trees.SpaceTree({}).split(1, (1, 0, 0, 0)).split(3, (0, 1, 0, 0))
    assert t.leaves() == [2, 6, 7] and t.merge(3).leaves() == [2, 3] and t.merge(1).leaves() == [1]
    with pytest.raises(ValueError):
        t.split(3, (0, 0, 1, 0))


def test_text_readers():
    a = text_formats.parse_abaqus(b"** c\n*NODE\n1, 0, 0\n2, 1, 0\n3, 0, 1\n4, 1, 1\n*ELEMENT, TYPE=CPE3, ELSET=E\n5, 1, 2, 3\n6, 2,\n4, 3\n*NSET, NSET=N\n1, 2,\n3\n*ELSET, ELSET=F\nE, 6\n")
    assert a.cells == [(TRI, [0, 1, 2]), (TRI, [1, 3, 2])] and a.sets == {"E": [0, 1], "F": [0, 1, 1]} and a.point_sets["N"] == [0, 1, 2]
    with pytest.raises(MeshError):
        text_formats.parse_abaqus(b"*NODE\n1,0,0\n*ELEMENT, TYPE=ODD9\n1, 1\n")
    u = text_formats.parse_ideas(b"    -1\n   151\nx\n    -1\n    -1\n  2411\n 7 1 1 11\n 0.0D+00 1.5D+00 0.0\n 8 1 1 11\n 1 0 0\n    -1\n    -1\n  2412\n 1 21 1 5 7 2\n 0 0 0\n 7 8\n    -1\n")
    assert u.points[0] == (0.0, 1.5, 0.0) and u.cells == [(EDGE, [0, 1])] and u.sets == {"material:5": [0]}
    with pytest.raises(MeshError):
        text_formats.parse_rtt(b"something else")
    with pytest.raises(MeshError):
        text_formats.parse_sms(b"no")
    cube = [[0, 3, 2, 1], [4, 5, 6, 7], [0, 1, 5, 4], [1, 2, 6, 5], [2, 3, 7, 6], [3, 0, 4, 7]]
    assert text_formats._region(cube) == (HEX, [1, 2, 3, 0, 5, 6, 7, 4])
    assert text_formats._region([[0, 2, 1], [0, 1, 3], [1, 2, 3], [2, 0, 3]]) == (TET, [1, 2, 0, 3])
    assert text_formats._region([[0, 2, 1], [3, 4, 5], [0, 1, 4, 3], [1, 2, 5, 4], [2, 0, 3, 5]])[0] == PRISM
    with pytest.raises(MeshError):
        text_formats._region([[0, 1, 2]])
    assert files.parse_vtk(b"# vtk DataFile Version 2.0\nt\nASCII\nDATASET POLYDATA\nPOINTS 5 float\n0 0 0 1 0 0 1 1 0 0 1 0 2 2 0\nPOLYGONS 1 6\n5 0 1 2 4 3\n").cells[0][0] == POLYGON


def test_tools(spark, tmp_path):
    m = mesh_from_arrays(spark, [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (1 + 1e-9, 0, 0), (2, 0, 0), (2, 1, 0), (1, 1 + 1e-9, 0)], [("QUAD", [0, 1, 2, 3]), ("QUAD", [4, 5, 6, 7])])
    one = f"file://{tmp_path}/one.vtk"
    files.save_vtk(m, one)
    cli.run(spark, ["merge", one, f"file://{tmp_path}/two.msh", "--tolerance", "1e-6"])
    two = cli.read(spark, f"file://{tmp_path}/two.msh")
    assert (two.vertices.count(), two.elements.count()) == (6, 2)
    assert [(r.depth, r.n) for r in cli.run(spark, ["depth", f"file://{tmp_path}/two.msh"]).collect()] == [(0, 2)]
    assert {r.name for r in cli.run(spark, ["sets", f"file://{tmp_path}/two.msh"]).collect()} == {"material:1"}
    cli.run(spark, ["convert", f"file://{tmp_path}/two.msh", f"file://{tmp_path}/kept"])
    assert cli.read(spark, f"file://{tmp_path}/kept").elements.count() == 2
    assert cli.run(spark, ["compare", one, one]).count() == 0
    with pytest.raises(MeshError):
        cli.run(spark, ["convert", one, f"file://{tmp_path}/x.strange"])
    with pytest.raises(MeshError):
        cli.run(spark, ["convert", one, f"file://{tmp_path}/y.vtk", "--options", "NOT_KNOWN=1"])
    with pytest.raises(SystemExit):
        cli.run(spark, ["no-such-command"])


def test_target_metrics_of_the_target(spark):
    from lattica.functions.geometry import V

    rows = spark.createDataFrame([(0.0,)], "zero double")
    corner = [V(*(F.col("zero") + float(row[j]) for row in targets.REGULAR)) for j in range(3)]
    p = [V(F.col("zero"), F.col("zero"), F.col("zero")), *corner]
    t = targets.relative(p)
    got = rows.select(*(f(t).alias(n) for n, f in targets.TARGET.items()), *(f(t).alias(f"e_{n}") for n, f in targets.ELEMENT.items()), targets.aspect_ratio_gamma(p).alias("gamma")).first().asDict()
    assert all(abs(got[n]) < 1e-9 for n in targets.TARGET)
    assert abs(got["e_mean_ratio"] - 1) < 1e-9 and abs(got["e_condition_number"] - 1) < 1e-9
