"""Vertices at one place, and points beside the sides of elements."""

import random

from lattica import model
from lattica.functions import shapes
from lattica.operators import distribution, mutation, spatial
from lattica.operators.evaluator import Evaluator
from lattica.plans import tables

XYZ = "handle long, x double, y double, z double"


def test_parts_that_coincide_are_merged_by_place(spark, monkeypatch):
    seen, near = [], mutation.close_pairs
    monkeypatch.setattr(mutation, "close_pairs", lambda points, tolerance: (seen.append(points.count()), near(points, tolerance))[1])
    copies = spark.createDataFrame([(h, float(h % 3), 0.0, 0.0) for h in range(1, 301)], XYZ).selectExpr("*", "handle % 4 AS part")
    got = {r["handle"]: r["gid"] for r in distribution.merged_parts(copies, 0.5).collect()}
    assert got == {h: (h - 1) % 3 + 1 for h in range(1, 301)}
    assert seen == [3]  # never pairs of all vertices of a place


def test_merging_agrees_with_brute_force(spark):
    r = random.Random(3)
    spots = [tuple(r.choice((0.0, 0.4, 0.7, 1.1, 5.0)) for _ in "xyz") for _ in range(12)]
    rows = [(h, *r.choice(spots)) for h in r.sample(range(1, 500), 150)] + [(600, float("nan"), 0.0, 0.0), (601, float("nan"), 0.0, 0.0)]
    kept, want = [], {}
    for h, *p in sorted(rows):
        close = [k for k, q in kept if sum((a - b) ** 2 for a, b in zip(p, q)) < 0.5**2]
        if close:
            want[h] = max(close)
        else:
            kept.append((h, p))
    assert {x["handle"]: x["keep"] for x in mutation.merge_map(spark.createDataFrame(rows, XYZ), 0.5).collect()} == want


def _points(spark, xs):
    return spark.createDataFrame([(i, x, 1.5, 1.25) for i, x in enumerate(xs)], "pid long, x double, y double, z double")


def test_points_beside_a_side_lie_in_the_element_that_holds_them(spark):
    """On a side in the smallest handle; by 2e-8 beyond it in the next; outside of all by the tolerance."""
    xs = [2.0, 2.0 + 2e-8, 2.0 - 2e-8, 4.0 + 2e-8]
    quads = Evaluator(tables.tri_mesh(spark, 4), model.TRI).containing(_points(spark, xs).selectExpr("pid", "x", "y", "0D AS z"))
    cell = {r["pid"]: (model_id(r["handle"]) - 1) // 2 - 4 for r in quads.collect()}
    assert cell == {0: 1, 1: 2, 2: 1, 3: 3}
    hexes = spatial.locate_in_hexes(_points(spark, xs), tables.hex_mesh(spark, 4)).collect()
    assert {r["pid"]: model_id(r["handle"]) - 1 - 4 - 16 for r in hexes} == {0: 1, 1: 2, 2: 1, 3: 3}


def model_id(handle):
    return handle & model.ID_MASK


def test_natural_coordinates_of_binary_fractions_are_exact(spark):
    xs = [i / 256 for i in range(1, 1024)]
    got = {r["pid"]: r["xi"] for r in spatial.locate_in_hexes(_points(spark, xs), tables.hex_mesh(spark, 4)).collect()}
    assert got == {i: 2 * (x - -(-x // 1)) + 1 for i, x in enumerate(xs)}
    assert shapes.settled(shapes.np.array([1 + 1e-15, 0.1])).tolist() == [1.0, round(0.1 * 2**40) / 2**40]
