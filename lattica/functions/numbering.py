"""Canonical numbering: the sub-entities of each element type, and comparisons of connectivity."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import CORNERS, EDGE, HEX, KNIFE, POLYGON, PRISM, PYRAMID, QUAD, TET, TRI

# Local vertex positions of the edges and of the faces of each type, in side order.
EDGES = {
    EDGE: "01", TRI: "01 12 20", QUAD: "01 12 23 30", TET: "01 12 20 03 13 23", PYRAMID: "01 12 23 30 04 14 24 34",
    PRISM: "01 12 20 03 14 25 34 45 53", KNIFE: "01 12 23 30 04 15 26 35 45 56", HEX: "01 12 23 30 04 15 26 37 45 56 67 74",
}
FACES = {
    TRI: "012", QUAD: "0123", TET: "013 123 032 021", PYRAMID: "014 124 234 304 0321",
    PRISM: "0143 1254 0352 021 345", KNIFE: "0154 1265 2356 3045 0321", HEX: "0154 1265 2376 3047 0321 4567",
}


@cache
def rows() -> tuple[tuple[int, int, int, int, tuple[int, ...]], ...]:
    """``(etype, subdim, side, sub_etype, local positions)`` of all fixed types, corners included as subdim 0."""
    out = []
    for etype, n in enumerate(CORNERS):
        if n > 1:
            out += [(etype, 0, i, 0, (i,)) for i in range(n)]
    for etype, text in EDGES.items():
        out += [(etype, 1, i, EDGE, tuple(map(int, s))) for i, s in enumerate(text.split())]
    for etype, text in FACES.items():
        out += [(etype, 2, i, TRI if len(s) == 3 else QUAD, tuple(map(int, s))) for i, s in enumerate(text.split())]
    return tuple(out)


def table(spark: SparkSession) -> DataFrame:
    """The sub-entity table as a relation (about two hundred rows)."""
    return spark.createDataFrame([(*r[:4], list(r[4])) for r in rows()], "etype int, subdim int, side int, sub_etype int, local array<int>")


def sides(etype: int, subdim: int) -> list[tuple[int, tuple[int, ...]]]:
    """``(sub_etype, local positions)`` of the sides of a type, in order."""
    return [(r[3], r[4]) for r in rows() if r[0] == etype and r[1] == subdim]


def _local(conn: Column, local: tuple[int, ...]) -> Column:
    return F.array(*(F.element_at(conn, i + 1) for i in local))


def sub_connectivity(etype: Column, conn: Column, subdim: int, types: list[int] | None = None) -> Column:
    """Array of ``(side, sub_etype, sub_conn)`` of an element: pure column arithmetic, no join.

    ``types`` says which element types occur, if that is known. Polygons give
    their edges by rule; an element of dimension ``subdim`` is its own side 0.
    """
    side = lambda k, t, c: F.struct(F.lit(k).alias("side"), F.lit(t).alias("sub_etype"), c.alias("sub_conn"))
    out: Column = F.lit(None)
    for t in sorted(types if types is not None else {r[0] for r in rows()}):
        found = sides(t, subdim)
        if found:
            out = F.when(etype == t, F.array(*(side(k, s, _local(conn, local)) for k, (s, local) in enumerate(found)))).otherwise(out)
    if types is None or POLYGON in types:
        n = F.size(conn)
        if subdim == 1:
            ring = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("side"), F.lit(EDGE).alias("sub_etype"), F.array(F.element_at(conn, i + 1), F.element_at(conn, (i + 1) % n + 1)).alias("sub_conn")))
            out = F.when(etype == POLYGON, ring).otherwise(out)
        elif subdim == 2:
            out = F.when(etype == POLYGON, F.array(side(0, POLYGON, conn))).otherwise(out)
        else:
            corner = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("side"), F.lit(0).alias("sub_etype"), F.array(F.element_at(conn, i + 1)).alias("sub_conn")))
            out = F.when(etype == POLYGON, corner).otherwise(out)
    return out


def key(conn: Column) -> Column:
    """Sorted vertices: what entities with the same vertices have in common."""
    return F.array_sort(conn)


def rotated(conn: Column) -> Column:
    """A connectivity turned so that its smallest vertex comes first."""
    at = F.array_position(conn, F.array_min(conn)).cast("int")
    return F.concat(F.slice(conn, at, F.size(conn)), F.slice(conn, F.lit(1), at - 1))


def match(one: Column, other: Column) -> Column:
    """``(matches, direct, offset)`` of two rings of vertices.

    ``direct`` is 1 where the second runs the same way as the first, -1 where
    it runs backwards; ``offset`` is the place in the second of the first's
    start.
    """
    same = rotated(one) == rotated(other)
    back = rotated(F.reverse(one)) == rotated(other)
    offset = (F.array_position(other, F.element_at(one, 1)) - 1).cast("int")
    return F.struct((same | back).alias("matches"), F.when(same, 1).when(back, -1).otherwise(0).alias("direct"), F.when(same | back, offset).otherwise(-1).alias("offset"))


def corner_count(etype: Column, conn: Column) -> Column:
    n = F.element_at(F.array(*map(F.lit, CORNERS)), etype.cast("int") + 1)
    return F.when(n > 0, F.least(n, F.size(conn))).otherwise(F.size(conn))


def side_of(etype: int, child: tuple[int, ...]) -> tuple[int, int, int] | None:
    """``(side, sense, offset)`` of a child given by the parent's local positions; None if it is no side."""
    for dim in (1, 2):
        for k, (_, local) in enumerate(sides(etype, dim)):
            if len(local) == len(child) and set(local) == set(child):
                n = len(local)
                at = child.index(local[0])
                if all(child[(at + i) % n] == local[i] for i in range(n)):
                    return k, 1, at
                if all(child[(at - i) % n] == local[i] for i in range(n)):
                    return k, -1, at
    return None


def opposite_side(etype: int, subdim: int, side: int) -> tuple[int, int] | None:
    """``(dimension, side)`` of the side that shares no vertex with the given one; None if there is none."""
    own = set(sides(etype, subdim)[side][1])
    rest = set(range(CORNERS[etype])) - own
    for dim in (2, 1, 0):
        for k, (_, local) in enumerate(sides(etype, dim)):
            if set(local) == rest or dim == subdim and not own & set(local) and len(local) == len(own) and len(sides(etype, dim)) > 2 and etype == HEX and dim == 2:
                return dim, k
    if etype == HEX and subdim == 1:
        # the edge diagonally across: the one that lies in no face with the given edge
        shared = {k for _, f in sides(etype, 2) if own <= set(f) for k, (_, e) in enumerate(sides(etype, 1)) if set(e) <= set(f)}
        meeting = {k for k, (_, e) in enumerate(sides(etype, 1)) if own & set(e)}
        left = [k for k in range(len(sides(etype, 1))) if k not in shared | meeting and not any(len(own & set(f)) == 1 and set(sides(etype, 1)[k][1]) <= set(f) for _, f in sides(etype, 2))]
        return (1, left[0]) if len(left) == 1 else None
    return None


def adjacent_sides(etype: int, subdim: int, side_list: list[int], other_dim: int, every: bool) -> list[int]:
    """Sides of ``other_dim`` that share a sub-entity with any (or every) listed side."""
    got = []
    for k, (_, local) in enumerate(sides(etype, other_dim)):
        touch = [set(local) <= set(sides(etype, subdim)[s][1]) or set(local) >= set(sides(etype, subdim)[s][1]) for s in side_list]
        if (all if every else any)(touch):
            got.append(k)
    return got


def mid_nodes(etype: int, n_nodes: int) -> tuple[bool, bool, bool]:
    """Whether an element of so many nodes has mid-edge, mid-face and mid-volume nodes."""
    corners, edges, faces = CORNERS[etype], len(sides(etype, 1)), len(sides(etype, 2))
    from ..model import DIMENSIONS

    dim = DIMENSIONS[etype]
    for e in (False, True):
        for f in (False, True):
            for v in (False, True):
                if dim < 3 and v or dim < 2 and f:
                    continue
                extra = (edges if dim > 1 else 1) * e + (faces if dim == 3 else 1) * f + v
                if corners + extra == n_nodes:
                    return e, f, v
    return False, False, False
