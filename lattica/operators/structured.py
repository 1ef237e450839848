"""Structured boxes: vertices and elements by arithmetic on ``(i, j, k)``, i fastest."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..model import Mesh, Tag


@dataclass(frozen=True)
class Box:
    """A block of vertices from ``low`` to ``high`` (both included); flat in k gives quads.

    Elements run from ``low`` to below ``high``; along a periodic direction the
    last element closes onto the first vertex.
    """

    low: tuple[int, int, int]
    high: tuple[int, int, int]
    periodic: tuple[bool, bool] = (False, False)
    first_vertex: int = 1
    first_element: int = 1

    @property
    def flat(self) -> bool:
        return self.low[2] == self.high[2]

    @property
    def vertex_counts(self) -> tuple[int, int, int]:
        return tuple(h - lo + 1 for lo, h in zip(self.low, self.high))

    @property
    def element_counts(self) -> tuple[int, int, int]:
        n = [h - lo for lo, h in zip(self.low, self.high)]
        for d in (0, 1):
            n[d] += self.periodic[d]
        return n[0], n[1], 1 if self.flat else n[2]

    def vertex(self, i: Column, j: Column, k: Column) -> Column:
        """Handle of the vertex at ``(i, j, k)``, wrapped along periodic directions."""
        nx, ny, _ = self.vertex_counts
        a, b, c = i - self.low[0], j - self.low[1], k - self.low[2]
        if self.periodic[0]:
            a = a % nx
        if self.periodic[1]:
            b = b % ny
        return (F.lit(self.first_vertex) + a + nx * b + nx * ny * c).cast("long")

    def element(self, i: Column, j: Column, k: Column) -> Column:
        ex, ey, _ = self.element_counts
        ident = F.lit(self.first_element) + (i - self.low[0]) + ex * (j - self.low[1]) + ex * ey * (k - self.low[2])
        return model.handle(model.QUAD if self.flat else model.HEX, ident)

    def _params(self, spark: SparkSession, counts: tuple[int, int, int]) -> DataFrame:
        nx, ny, nz = counts
        at, n = F.col("id"), nx * ny * nz
        return spark.range(0, n, 1, model.slices(spark, n) or spark.sparkContext.defaultParallelism).select((at % nx + self.low[0]).alias("i"), (F.floor(at / nx) % ny + self.low[1]).alias("j"), (F.floor(at / (nx * ny)) + self.low[2]).alias("k"))

    def vertices(self, spark: SparkSession, coords: tuple[Column, Column, Column] | None = None) -> DataFrame:
        """``(handle, i, j, k, x, y, z)``; coordinates are the parameters unless given by expressions of them."""
        x, y, z = coords or (F.col("i"), F.col("j"), F.col("k"))
        p = self._params(spark, self.vertex_counts)
        return p.select(self.vertex(F.col("i"), F.col("j"), F.col("k")).alias("handle"), "i", "j", "k", x.cast("double").alias("x"), y.cast("double").alias("y"), z.cast("double").alias("z"))

    def elements(self, spark: SparkSession) -> DataFrame:
        """``(handle, etype, conn, i, j, k)``."""
        i, j, k = (F.col(c) for c in "ijk")
        ring = [(0, 0), (1, 0), (1, 1), (0, 1)]
        conn = [self.vertex(i + a, j + b, k) for a, b in ring]
        if not self.flat:
            conn += [self.vertex(i + a, j + b, k + 1) for a, b in ring]
        etype = model.QUAD if self.flat else model.HEX
        return self._params(spark, self.element_counts).select(self.element(i, j, k).alias("handle"), F.lit(etype).alias("etype"), F.array(*conn).alias("conn"), "i", "j", "k")

    def mesh(self, spark: SparkSession, coords: tuple[Column, Column, Column] | None = None) -> Mesh:
        return Mesh(self.vertices(spark, coords).drop("i", "j", "k"), self.elements(spark).drop("i", "j", "k"), rows=math.prod(self.element_counts))

    def params(self, handles: DataFrame) -> DataFrame:
        """``(handle, i, j, k)`` of vertices or elements of the box."""
        h, t = model.id_of(F.col("handle")), model.etype_of(F.col("handle"))
        vx, vy, _ = self.vertex_counts
        ex, ey, _ = self.element_counts
        at = F.when(t == model.VERTEX, h - self.first_vertex).otherwise(h - self.first_element)
        nx, ny = F.when(t == model.VERTEX, vx).otherwise(ex), F.when(t == model.VERTEX, vy).otherwise(ey)
        return handles.select("handle", (at % nx + self.low[0]).alias("i"), (F.floor(at / nx) % ny + self.low[1]).alias("j"), (F.floor(at / (nx * ny)) + self.low[2]).alias("k"))

    def contains(self, i: Column, j: Column, k: Column) -> Column:
        return i.between(self.low[0], self.high[0]) & j.between(self.low[1], self.high[1]) & k.between(self.low[2], self.high[2])

    def skin(self, spark: SparkSession) -> DataFrame:
        """Boundary facets of a hex box by the bounds alone: ``(elem, side)``; no grouping is needed."""
        e = self.elements(spark)
        n = self.element_counts
        faces = []
        for d, (low, high) in enumerate(((3, 1), (0, 2), (4, 5))):
            if d < 2 and self.periodic[d]:
                continue
            c = F.col("ijk"[d]) - self.low[d]
            faces += [F.when(c == 0, F.lit(low)), F.when(c == n[d] - 1, F.lit(high))]
        return e.select(F.col("handle").alias("elem"), F.explode(F.filter(F.array(*faces), lambda s: s.isNotNull())).alias("side"))

    def adjacent_edge(self, spark: SparkSession, direction: int) -> DataFrame:
        """Edges of the grid along a direction: ``(i, j, k, v0, v1)``, wrapped where periodic."""
        n = list(self.vertex_counts)
        if not (direction < 2 and self.periodic[direction]):
            n[direction] -= 1
        i, j, k = (F.col(c) for c in "ijk")
        step = [int(direction == d) for d in range(3)]
        return self._params(spark, tuple(n)).select("i", "j", "k", self.vertex(i, j, k).alias("v0"), self.vertex(i + step[0], j + step[1], k + step[2]).alias("v1"))


BOX_DIMS = "BOX_DIMS"


def add_box(mesh: Mesh, box: Box) -> tuple[Mesh, int]:
    """A set for a box of the mesh, with its bounds, periods and first ids in tag BOX_DIMS; returns the set's handle."""
    spark = mesh.spark
    none = mesh.sets is None
    sets = spark.createDataFrame([], "handle long, flags int") if none else mesh.sets
    last = sets.agg(F.max("handle")).first()[0] or (model.ENTITYSET << model.SHIFT)
    handle = last + 1
    row = [*box.low, *box.high, *map(int, box.periodic), box.first_vertex, box.first_element]
    value = spark.createDataFrame([(handle, row)], "entity long, value array<long>")
    old = mesh.tags.get(BOX_DIMS)
    tag = Tag(BOX_DIMS, "long", value if old is None else old.values.unionByName(value), None, len(row), "sparse")
    made = spark.createDataFrame([(handle, model.SET_LIKE)], "handle long, flags int")
    inside = box.vertices(spark).select("handle").union(box.elements(spark).select("handle"))
    rows = inside.select(F.lit(handle).alias("set"), F.lit(0).cast("long").alias("pos"), F.col("handle").alias("entity"))
    members = rows if mesh.members is None else mesh.members.unionByName(rows)
    return mesh.with_(sets=sets.unionByName(made), members=members, tags=mesh.tags | {BOX_DIMS: tag}), handle


def find_boxes(mesh: Mesh) -> list[tuple[int, Box]]:
    """All boxes that sets of the mesh describe, by handle (a row each)."""
    if BOX_DIMS not in mesh.tags:
        return []
    rows = mesh.tags[BOX_DIMS].values.orderBy("entity").collect()
    return [(r["entity"], Box(tuple(v[:3]), tuple(v[3:6]), (bool(v[6]), bool(v[7])), v[8], v[9])) for r in rows for v in [r["value"]]]


def remove_box(mesh: Mesh, handle: int) -> Mesh:
    """Without the set and its tag; entities stay."""
    from dataclasses import replace

    tag = mesh.tag(BOX_DIMS)
    kept = replace(tag, values=tag.values.filter(F.col("entity") != handle))
    return mesh.with_(sets=mesh.sets.filter(F.col("handle") != handle), members=mesh.members.filter((F.col("set") != handle) & (F.col("entity") != handle)), tags=mesh.tags | {BOX_DIMS: kept})


def box_of(mesh: Mesh, entities: DataFrame) -> DataFrame:
    """``(handle, set)``: the box that each entity lies in, by the boxes' id ranges; a few rows are sent to all tasks."""
    rows = []
    for s, b in find_boxes(mesh):
        nv, ne = b.vertex_counts, b.element_counts
        t = (model.QUAD if b.flat else model.HEX) << model.SHIFT
        rows += [(s, b.first_vertex, b.first_vertex + nv[0] * nv[1] * nv[2] - 1), (s, t + b.first_element, t + b.first_element + ne[0] * ne[1] * ne[2] - 1)]
    spans = mesh.spark.createDataFrame(rows, "set long, low long, high long")
    return entities.join(F.broadcast(spans), F.col("handle").between(F.col("low"), F.col("high"))).select("handle", "set")


def shared_vertices(spark: SparkSession, boxes: list[Box]) -> DataFrame:
    """``(part, other, handle, twin)``: vertices of two parts' boxes with the same parameters."""
    every = None
    for part, b in enumerate(boxes):
        own = b.vertices(spark).select(F.lit(part).cast("long").alias("part"), "handle", "i", "j", "k")
        every = own if every is None else every.unionByName(own)
    other = every.select(F.col("part").alias("other"), F.col("handle").alias("twin"), "i", "j", "k")
    return every.join(other, ["i", "j", "k"]).filter("part != other").select("part", "other", "handle", "twin")


def partition(low: tuple[int, int, int], high: tuple[int, int, int], parts: int, method: str = "alljorkori") -> list[tuple[tuple[int, int, int], tuple[int, int, int]]]:
    """Blocks of an element range for each part.

    ``alljorkori`` cuts j if it has more than ``parts`` elements, else k, else i;
    ``alljkbal`` cuts j and k into factors as even as their extents; ``sqij``,
    ``sqjk`` and ``sqijk`` look for the most square (cubic) split of the named
    directions; the first ``n % parts`` blocks of a cut are one longer.
    """
    extent = [h - lo for lo, h in zip(low, high)]

    def cut(n: int, k: int) -> list[tuple[int, int]]:
        size, more = divmod(n, k)
        out, at = [], 0
        for p in range(k):
            step = size + (p < more)
            out.append((at, at + step))
            at += step
        return out

    ways = [1, 1, 1]
    if method == "alljorkori":
        ways[1 if extent[1] > parts else 2 if extent[2] > parts else 0] = parts
    else:
        free = {"alljkbal": (1, 2), "sqij": (0, 1), "sqjk": (1, 2), "sqijk": (0, 1, 2)}[method]
        best = None
        for a in range(1, parts + 1):
            for b in range(1, parts // a + 1):
                if parts % (a * b):
                    continue
                w = [1, 1, 1]
                split = (a, b, parts // (a * b)) if len(free) == 3 else (a, parts // a)
                if len(free) == 2 and b != parts // a:
                    continue
                for d, x in zip(free, split):
                    w[d] = x
                if any(w[d] > max(1, extent[d]) for d in range(3)):
                    continue
                lengths = [extent[d] / w[d] for d in free]
                score = max(lengths) / max(min(lengths), 1e-9)
                if best is None or score < best[0]:
                    best = score, w
        ways = best[1] if best else [parts, 1, 1]
    cuts = [cut(extent[d], ways[d]) for d in range(3)]
    return [((low[0] + a0, low[1] + b0, low[2] + c0), (low[0] + a1, low[1] + b1, low[2] + c1)) for c0, c1 in cuts[2] for b0, b1 in cuts[1] for a0, a1 in cuts[0]]
