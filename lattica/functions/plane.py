"""Polygons and segments in the plane, as column arithmetic over arrays of ``(x, y)`` structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = tuple[Column, Column]


def _next(points: Column, i: Column) -> Column:
    return F.element_at(points, ((i + 1) % F.size(points) + 1).cast("int"))


def _edges(points: Column) -> Column:
    """Pairs ``(p, q)`` of each corner and the one after it."""
    return F.transform(points, lambda p, i: F.struct(p.alias("p"), _next(points, i).alias("q")))


def area(points: Column) -> Column:
    """Signed area, above 0 for corners that run counter-clockwise."""
    return F.aggregate(_edges(points), F.lit(0.0), lambda a, e: a + (e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"]) / 2)


def in_convex(x: Column, y: Column, points: Column, eps: float = 1e-12) -> Column:
    """Whether a point lies in a convex polygon that runs counter-clockwise, edges included."""
    side = lambda e: (e["q"]["x"] - e["p"]["x"]) * (y - e["p"]["y"]) - (e["q"]["y"] - e["p"]["y"]) * (x - e["p"]["x"])
    return F.forall(_edges(points), lambda e: side(e) >= -eps)


def distance(a: Point, b: Point) -> Column:
    return F.sqrt((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2)


def crossing(a: Point, b: Point, c: Point, d: Point) -> Column:
    """``(x, y)`` where two segments meet; null where they don't, or are parallel."""
    r, s = (b[0] - a[0], b[1] - a[1]), (d[0] - c[0], d[1] - c[1])
    turn = r[0] * s[1] - r[1] * s[0]
    q = (c[0] - a[0], c[1] - a[1])
    t, u = (q[0] * s[1] - q[1] * s[0]) / turn, (q[0] * r[1] - q[1] * r[0]) / turn
    return F.when((turn != 0) & t.between(0, 1) & u.between(0, 1), F.struct((a[0] + t * r[0]).alias("x"), (a[1] + t * r[1]).alias("y")))


def sorted_ring(points: Column, least: float = 1e-12) -> Column:
    """Corners sorted by angle around their middle; of corners closer than ``least`` to the one before, one stays."""
    n = F.size(points)
    mx, my = (F.aggregate(points[c], F.lit(0.0), lambda a, v: a + v) / n for c in "xy")
    ring = F.array_sort(F.transform(points, lambda p: F.struct(F.atan2(p["y"] - my, p["x"] - mx).alias("angle"), p["x"].alias("x"), p["y"].alias("y"))))
    far = lambda p, q: (p["x"] - q["x"]) ** 2 + (p["y"] - q["y"]) ** 2 > least * least
    return F.filter(ring, lambda p, i: (i == 0) | far(p, F.element_at(ring, F.greatest(i, F.lit(1)).cast("int"))))
