"""Spatial queries as bucketed equi-joins: containment, nearest, radius, rays.

Boxes are cut into cells of a uniform grid and joined on equal cells; an exact
test follows. Each box lies in the grid whose cells are about as wide as itself,
there being as many grids as sizes ask for, so large elements don't multiply the
rows. The nearest triangle is found by going down a tree of cells.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import model
from ..functions import geometry as G
from ..functions import shapes
from ..functions.geometry import V
from ..model import Mesh
from . import measures
from .fixpoint import store


def bounds(mesh: Mesh, dim: int) -> DataFrame:
    """``(handle, x0, y0, z0, x1, y1, z1)`` of each element's vertices."""
    inc = mesh.elements.filter(model.of_dimension(F.col("handle"), dim)).select("handle", F.explode("conn").alias("vertex"))
    placed = inc.join(mesh.vertices.withColumnRenamed("handle", "vertex"), "vertex")
    return placed.groupBy("handle").agg(*(F.min(c).alias(f"{c}0") for c in "xyz"), *(F.max(c).alias(f"{c}1") for c in "xyz"))


def bounding_box(mesh: Mesh) -> DataFrame:
    """One row: the box of all vertices and the length of its diagonal."""
    box = mesh.vertices.agg(*(F.min(c).alias(f"{c}0") for c in "xyz"), *(F.max(c).alias(f"{c}1") for c in "xyz"))
    return box.withColumn("diagonal", F.sqrt(sum((F.col(f"{c}1") - F.col(f"{c}0")) ** 2 for c in "xyz")))


def _level(size: Column, cell: float) -> Column:
    """The finest grid level at which a box spans at most two cells a direction; level n has cells ``2**n`` as wide."""
    return F.greatest(F.lit(0), F.ceil(F.log2(size / cell))).cast("int")


def _levels(*levels: DataFrame) -> list[int]:
    """The levels that boxes lie at: a few dozen numbers at most, whatever the sizes."""
    found = levels[0]
    for more in levels[1:]:
        found = found.union(more)
    return sorted(r[0] for r in found.distinct().collect() if r[0] is not None) or [0]


def _cells(df: DataFrame, low: list[Column], high: list[Column], cell: float, level: Column) -> DataFrame:
    wide = F.lit(cell) * F.pow(F.lit(2.0), level)
    out = df.withColumn("_level", level.cast("int"))
    for c, lo, hi in zip("xyz", low, high):
        out = out.withColumn(f"_{c}", F.explode(F.sequence(F.floor(lo / wide), F.floor(hi / wide))))
    return out


def cell_size(boxes: DataFrame) -> float:
    """Median longest side of the boxes: the cell width of the grid's finest level."""
    side = F.greatest(*(F.col(f"{c}1") - F.col(f"{c}0") for c in "xyz"))
    found = boxes.agg(F.percentile_approx(side, 0.5)).first()[0]
    return float(found) if found else 1.0


def candidates(points: DataFrame, boxes: DataFrame, reach: float = 0.0, cell: float | None = None) -> DataFrame:
    """Pairs of ``points(pid, x, y, z)`` and boxes no farther than ``reach`` along each axis.

    Each box lies at one level of the grid; each point is looked up at all
    levels, so a pair meets once.
    """
    cell = max(cell or cell_size(boxes), reach, 1e-12)
    side = F.greatest(*(F.col(f"{c}1") - F.col(f"{c}0") for c in "xyz")) + 2 * reach
    cut = _cells(boxes, [F.col(f"{c}0") - reach for c in "xyz"], [F.col(f"{c}1") + reach for c in "xyz"], cell, _level(side, cell))
    at = points.withColumn("_level", F.explode(F.array(*map(F.lit, _levels(boxes.select(_level(side, cell)))))))
    wide = F.lit(cell) * F.pow(F.lit(2.0), F.col("_level"))
    at = at.select("*", *(F.floor(F.col(c) / wide).alias(f"_{c}") for c in "xyz"))
    met = at.join(cut, ["_level", "_x", "_y", "_z"])
    near = [(F.col(c) >= F.col(f"{c}0") - reach) & (F.col(c) <= F.col(f"{c}1") + reach) for c in "xyz"]
    return met.filter(near[0] & near[1] & near[2]).drop("_level", "_x", "_y", "_z")


def within_radius(points: DataFrame, tris: DataFrame, radius: float) -> DataFrame:
    """``(pid, handle, squared)`` of triangles ``(handle, a, b, c)`` within a distance of points ``(pid, x, y, z)``."""
    met = candidates(points, _boxed(tris), radius)
    p = V(F.col("x"), F.col("y"), F.col("z"))
    q = G.closest_on_triangle(p, V.of("a"), V.of("b"), V.of("c"))
    return met.select("pid", "handle", (p - q).squared().alias("squared")).filter(F.col("squared") <= radius * radius)


def _boxed(tris: DataFrame) -> DataFrame:
    """Triangles with their boxes."""
    return tris.select("*", *(F.least(*(F.col(f"{n}.{c}") for n in "abc")).alias(f"{c}0") for c in "xyz"), *(F.greatest(*(F.col(f"{n}.{c}") for n in "abc")).alias(f"{c}1") for c in "xyz"))


def _tree(boxes: DataFrame, cell: float) -> list[DataFrame]:
    """Levels of a tree of cells, ``(cx, cy, cz, x0 .. z1)``, from the leaves to a single root.

    A box belongs to the cell of its middle; a cell's bounds are those of all its
    boxes. Cells are numbered from the lowest middle, so halving leads to one root.
    """
    spark = boxes.sparkSession
    bounds_ = [F.min(f"{c}0").alias(f"{c}0") for c in "xyz"] + [F.max(f"{c}1").alias(f"{c}1") for c in "xyz"]
    out = [store(spark, boxes.groupBy("cx", "cy", "cz").agg(*bounds_))]
    top = out[0].agg(F.max(F.greatest("cx", "cy", "cz"))).first()[0] or 0
    while top:
        top //= 2
        up = out[-1].select(*(F.floor(F.col(f"c{c}") / 2).alias(f"c{c}") for c in "xyz"), *(f"{c}{i}" for i in (0, 1) for c in "xyz"))
        out.append(store(spark, up.groupBy("cx", "cy", "cz").agg(*bounds_)))
    return out


def closest_triangle(points: DataFrame, tris: DataFrame) -> DataFrame:
    """``(pid, handle, squared)`` of each point's nearest triangle; the smallest handle among equals.

    From the root of a tree of cells, each point keeps the cells that are no
    farther, at their nearest, than some cell is at its farthest, and goes on with
    their children; the triangles of the leaves that are left are measured.
    """
    spark = points.sparkSession
    box = store(spark, _boxed(tris))
    cell = max(cell_size(box), 1e-300)
    middle = {c: (F.col(f"{c}0") + F.col(f"{c}1")) / 2 for c in "xyz"}
    low = box.agg(*(F.min(m).alias(c) for c, m in middle.items())).first()
    if low["x"] is None:
        return points.select("pid", F.lit(None).cast("long").alias("handle"), F.lit(None).cast("double").alias("squared")).limit(0)
    box = store(spark, box.select("*", *(F.floor((m - F.lit(low[c])) / cell).alias(f"c{c}") for c, m in middle.items())))
    levels = _tree(box, cell)
    at = store(spark, points.select("pid", "x", "y", "z", *(F.lit(0).cast("long").alias(f"p{c}") for c in "xyz")))
    near = sum(F.pow(F.greatest(F.col(f"{c}0") - F.col(c), F.col(c) - F.col(f"{c}1"), F.lit(0.0)), 2) for c in "xyz")
    far = sum(F.pow(F.greatest(F.abs(F.col(c) - F.col(f"{c}0")), F.abs(F.col(c) - F.col(f"{c}1"))), 2) for c in "xyz")
    for level in reversed(levels[:-1]):
        kids = level.select("*", *(F.floor(F.col(f"c{c}") / 2).alias(f"p{c}") for c in "xyz"))
        met = at.join(kids, ["px", "py", "pz"]).select("pid", "x", "y", "z", "cx", "cy", "cz", near.alias("near"), far.alias("far"))
        least = F.min("far").over(Window.partitionBy("pid"))
        at = store(spark, met.withColumn("least", least).filter(F.col("near") <= F.col("least")).select("pid", "x", "y", "z", *(F.col(f"c{c}").alias(f"p{c}") for c in "xyz")))
    p = V(F.col("x"), F.col("y"), F.col("z"))
    q = G.closest_on_triangle(p, V.of("a"), V.of("b"), V.of("c"))
    leaves = box.select("handle", "a", "b", "c", *(F.col(f"c{c}").alias(f"p{c}") for c in "xyz"))
    found = at.join(leaves, ["px", "py", "pz"]).select("pid", "handle", (p - q).squared().alias("squared"))
    return found.groupBy("pid").agg(F.min(F.struct("squared", "handle")).alias("m")).select("pid", "m.handle", "m.squared")


def _ray_cells(rays: DataFrame, box: tuple[V, V], finest: float, levels: list[int]) -> DataFrame:
    """Grid cells along each ray within a box, at each level: one slice of its leading axis at a time."""
    rays = rays.withColumn("_level", F.explode(F.array(*map(F.lit, levels))))
    cell = F.lit(finest) * F.pow(F.lit(2.0), F.col("_level"))
    o, d = V.of("o"), V.of("d")
    span = G.ray_box(o, d, *box)
    inside = rays.withColumn("_span", span).filter("_span IS NOT NULL")
    most = F.greatest(F.abs(d.x), F.abs(d.y), F.abs(d.z))
    lead = lambda v: F.when(F.abs(d.x) == most, v.x).when(F.abs(d.y) == most, v.y).otherwise(v.z)
    start, stop = lead(o) + lead(d) * F.col("_span.enter"), lead(o) + lead(d) * F.col("_span.leave")
    slices = F.sequence(F.floor(F.least(start, stop) / cell), F.floor(F.greatest(start, stop) / cell))
    cut = inside.withColumn("_i", F.explode(slices))
    ends = [(F.col("_i") * cell - lead(o)) / lead(d), ((F.col("_i") + 1) * cell - lead(o)) / lead(d)]
    t = [F.greatest(F.col("_span.enter"), F.least(F.col("_span.leave"), e)) for e in ends]
    slack = cell * 1e-9
    for c in "xyz":
        at = [getattr(o, c) + getattr(d, c) * x for x in t]
        cut = cut.withColumn(f"_{c}", F.explode(F.sequence(F.floor((F.least(*at) - slack) / cell), F.floor((F.greatest(*at) + slack) / cell))))
    return cut.drop("_span", "_i").distinct()


def ray_hits(rays: DataFrame, tris: DataFrame, limit: float | None = None) -> DataFrame:
    """``(rid, handle, t, direction)`` of all triangles that rays ``(rid, o, d)`` cross.

    ``direction`` is 1 where the ray runs with the triangle's normal (leaving),
    -1 against it. Rays and triangles meet in the cells of a grid: a ray visits
    the cells along its way at each level, a triangle lies in those of its box at
    its own.
    """
    box = _boxed(tris)
    cell = cell_size(box)
    whole = box.agg(*(F.min(f"{c}0").alias(f"{c}0") for c in "xyz"), *(F.max(f"{c}1").alias(f"{c}1") for c in "xyz")).first()
    if whole["x0"] is None:
        whole = dict.fromkeys(("x0", "y0", "z0", "x1", "y1", "z1"), 0.0)
    wide = [V.const(*(whole[f"{c}{i}"] for c in "xyz")) for i in (0, 1)]
    level = _level(F.greatest(*(F.col(f"{c}1") - F.col(f"{c}0") for c in "xyz")), cell)
    cut = _cells(box, [F.col(f"{c}0") for c in "xyz"], [F.col(f"{c}1") for c in "xyz"], cell, level)
    o, d, a, b, c = (V.of(n) for n in ("o", "d", "a", "b", "c"))
    normal = (b - a).cross(c - a).dot(d)
    met = _ray_cells(rays, (wide[0], wide[1]), cell, _levels(box.select(level))).join(cut, ["_level", "_x", "_y", "_z"])
    hits = met.withColumn("t", G.ray_triangle(o, d, a, b, c, limit)).filter("t IS NOT NULL")
    return hits.select("rid", "handle", "t", F.when(normal > 0, 1).when(normal < 0, -1).otherwise(0).alias("direction")).distinct()


def axis_ray_hits(origins: DataFrame, tris: DataFrame) -> DataFrame:
    """Hits of rays along +x from ``origins(rid, x, y, z)``: dealt by cells of y and z, an equi-join."""
    flat = _boxed(tris).withColumn("x0", F.lit(0.0)).withColumn("x1", F.lit(0.0))
    met = candidates(origins.select(F.col("rid").alias("pid"), F.lit(0.0).alias("x"), "y", "z", F.col("x").alias("from_x")), flat)
    o, d = V(F.col("from_x"), F.col("y"), F.col("z")), V.const(1, 0, 0)
    a, b, c = (V.of(n) for n in "abc")
    normal = (b - a).cross(c - a).dot(d)
    hits = met.withColumn("t", G.ray_triangle(o, d, a, b, c)).filter("t IS NOT NULL")
    return hits.select(F.col("pid").alias("rid"), "handle", "t", F.when(normal > 0, 1).when(normal < 0, -1).otherwise(0).alias("direction"))


def fire(rays: DataFrame, tris: DataFrame, history: DataFrame | None = None, orientation: int | None = None, limit: float | None = None) -> DataFrame:
    """``(rid, handle, t)``: each ray's nearest crossing, leaving out triangles of its ``history(rid, handle)``."""
    hits = ray_hits(rays, tris, limit=limit)
    if history is not None:
        hits = hits.join(history, ["rid", "handle"], "left_anti")
    if orientation is not None:
        hits = hits.filter(F.col("direction") == orientation)
    return hits.groupBy("rid").agg(F.min(F.struct("t", "handle")).alias("m")).select("rid", "m.handle", "m.t")


def inverse_trilinear(points: np.ndarray, corners: np.ndarray, rounds: int = 10, tolerance: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """Natural coordinates of points in hexahedra by Newton's method, and whether it converged; all pairs at once."""
    signs = np.array([(-1, -1, -1), (1, -1, -1), (1, 1, -1), (-1, 1, -1), (-1, -1, 1), (1, -1, 1), (1, 1, 1), (-1, 1, 1)], float)
    xi = np.full((len(points), 3), -0.4)
    ok = np.zeros(len(points), bool)
    for _ in range(rounds):
        f = 1 + xi[:, None, :] * signs
        shape = f.prod(2) / 8
        res = np.einsum("nk,nkd->nd", shape, corners) - points
        ok = (res**2).sum(1) <= tolerance**2
        if ok.all():
            break
        grad = np.stack([signs[:, 0] * f[..., 1] * f[..., 2], signs[:, 1] * f[..., 0] * f[..., 2], signs[:, 2] * f[..., 0] * f[..., 1]], 2) / 8
        jac = np.einsum("nkd,nke->ned", grad, corners)
        flat = np.abs(np.linalg.det(jac)) < 1e-16
        jac[flat] = np.eye(3)
        step = np.linalg.solve(jac, res[..., None])[..., 0]
        step[ok | flat] = 0
        xi -= step
    return shapes.settled(xi), ok


def innermost(located: DataFrame, out: Column) -> DataFrame:
    """One of ``located(pid, handle, xi, eta, zeta)`` for each point: the least far ``out``, and the smallest handle of those that hold it."""
    best = F.min(F.struct(F.greatest(out, F.lit(0.0)).alias("out"), "handle", "xi", "eta", "zeta"))
    return located.groupBy("pid").agg(best.alias("m")).select("pid", "m.handle", "m.xi", "m.eta", "m.zeta")


def locate_in_tets(points: DataFrame, mesh: Mesh, tolerance: float = 1e-10) -> DataFrame:
    """``(pid, handle, xi, eta, zeta)`` of points in tetrahedra, with coordinates from 0; the smallest handle among several."""
    pts = measures.corner_points(mesh, etype=model.TET)
    met = candidates(points, bounds(mesh, 3), tolerance).join(pts, "handle")
    a, b, c, e = (V.at(F.col("points"), i) for i in range(4))
    p = V(F.col("x"), F.col("y"), F.col("z"))
    d = G.det(b - a, c - a, e - a)
    xi, eta, zeta = G.det(p - a, c - a, e - a) / d, G.det(b - a, p - a, e - a) / d, G.det(b - a, c - a, p - a) / d
    inside = met.select("pid", "handle", xi.alias("xi"), eta.alias("eta"), zeta.alias("zeta")).filter((F.col("xi") >= -tolerance) & (F.col("eta") >= -tolerance) & (F.col("zeta") >= -tolerance) & (F.col("xi") + F.col("eta") + F.col("zeta") <= 1 + tolerance))
    return inside.groupBy("pid").agg(F.min(F.struct("handle", "xi", "eta", "zeta")).alias("m")).select("pid", "m.*")


def locate_in_hexes(points: DataFrame, mesh: Mesh, tolerance: float = 1e-6) -> DataFrame:
    """``(pid, handle, xi, eta, zeta)`` of points in hexahedra, coordinates from -1 to 1; the smallest handle among several.

    A hexahedron that holds a point goes before those that hold it by the tolerance only.
    """
    pts = measures.corner_points(mesh, etype=model.HEX)
    met = candidates(points, bounds(mesh, 3), tolerance).join(pts, "handle").select("pid", "handle", "x", "y", "z", "points")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            p = np.stack([batch.column(c).to_numpy() for c in "xyz"], 1)
            flat = batch.column("points").flatten()
            corners = np.stack([flat.field(c).to_numpy() for c in "xyz"], 1).reshape(len(batch), 8, 3)
            xi, ok = inverse_trilinear(p, corners)
            ok &= (np.abs(xi) <= 1 + tolerance).all(1)
            out = pa.RecordBatch.from_arrays([batch.column("pid"), batch.column("handle"), *(pa.array(xi[:, k]) for k in range(3))], ["pid", "handle", "xi", "eta", "zeta"])
            yield out.filter(pa.array(ok))

    inside = met.mapInArrow(run, "pid long, handle long, xi double, eta double, zeta double")
    return innermost(inside, F.greatest(*(F.abs(c) for c in ("xi", "eta", "zeta"))) - 1)


def box_overlap_pairs(a: DataFrame, b: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """``(a, b)``: pairs of overlapping boxes ``(handle, x0..z1)``, through the grid's cells.

    Both sides lie at one level each; the coarser of the two is met by looking
    the finer one up at every coarser level.
    """
    cell = max(cell_size(a), cell_size(b), 1e-12)
    low, high = [F.col(f"{c}0") - tolerance for c in "xyz"], [F.col(f"{c}1") + tolerance for c in "xyz"]
    side = F.greatest(*(F.col(f"{c}1") - F.col(f"{c}0") for c in "xyz")) + 2 * tolerance
    found, levels = None, _levels(a.select(_level(side, cell)), b.select(_level(side, cell)))
    for first, second, tie in ((a, b, True), (b, a, False)):
        # every box of `first` at its own level, those of `second` at that level or a finer one
        one = _cells(first.withColumn("_own", _level(side, cell)), low, high, cell, _level(side, cell))
        own = second.withColumn("_own2", _level(side, cell)).withColumn("_at", F.explode(F.array(*map(F.lit, levels)))).filter(F.col("_at") >= F.col("_own2") if tie else F.col("_at") > F.col("_own2"))
        two = _cells(own, low, high, cell, F.col("_at")).select("_level", "_x", "_y", "_z", *(F.col(c).alias(f"o_{c}") for c in ("handle", *(f"{x}{i}" for x, i in itertools.product("xyz", "01")))))
        near = None
        for c in "xyz":
            t = (F.col(f"{c}0") <= F.col(f"o_{c}1") + tolerance) & (F.col(f"o_{c}0") <= F.col(f"{c}1") + tolerance)
            near = t if near is None else near & t
        met = one.join(two, ["_level", "_x", "_y", "_z"]).filter(near)
        pair = met.select(F.col("handle").alias("a"), F.col("o_handle").alias("b")) if tie else met.select(F.col("o_handle").alias("a"), F.col("handle").alias("b"))
        found = pair if found is None else found.unionByName(pair)
    return found.distinct()
