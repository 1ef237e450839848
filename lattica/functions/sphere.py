"""Great circles and cells of a sphere, as column arithmetic: crossings of arcs, orientation, repair of cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import model
from .geometry import V


def _on_arc(p: V, a: V, b: V, normal: V, eps: float) -> Column:
    return (a.cross(p).dot(normal) >= -eps) & (p.cross(b).dot(normal) >= -eps)


def arc_crossing(a: V, b: V, c: V, d: V, eps: float = 1e-12) -> Column:
    """``(x, y, z)`` of the unit sphere where the arcs from a to b and from c to d cross; null where they don't, or lie on one circle."""
    one, two = a.cross(b), c.cross(d)
    line = one.cross(two)
    size = line.length()
    p = line / size
    back = p * -1.0
    met = lambda q: _on_arc(q, a, b, one, eps) & _on_arc(q, c, d, two, eps)
    return F.when(size > eps, F.when(met(p), p.struct()).when(met(back), back.struct()))


def latitude_crossings(a: V, b: V, height: float) -> Column:
    """Points of the arc from a to b, less than half a circle, at a constant z, as an array (none, one or two)."""
    w = a.cross(b)
    w = w / w.length()
    u = w.cross(a)  # a and u span the circle: a cos t + u sin t
    size = F.sqrt(a.z * a.z + u.z * u.z)
    base, half = F.atan2(u.z, a.z), F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), height / size)))
    end = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), a.dot(b))))

    def at(t: Column) -> Column:
        turn = t - 2 * 3.141592653589793 * F.floor((t + 1e-12) / (2 * 3.141592653589793))
        p = a * F.cos(turn) + u * F.sin(turn)
        return F.when(turn <= end + 1e-12, p.struct())

    found = F.array(at(base - half), at(base + half))
    return F.when(F.abs(F.lit(height)) <= size, F.array_distinct(F.filter(found, lambda q: q.isNotNull()))).otherwise(F.slice(found, 1, 0))


def is_positive(points: Column) -> Column:
    """Whether a cell runs counter-clockwise seen from outside, by its first three corners."""
    a, b, c = (V.at(points, i) for i in range(3))
    return a.cross(b).dot(c) > 0


def positive(conn: Column, points: Column) -> Column:
    """Connectivity turned round where the cell runs clockwise; the first vertex stays."""
    back = F.concat(F.slice(conn, 1, 1), F.reverse(F.slice(conn, F.lit(2), F.size(conn) - 1)))
    return F.when(is_positive(points), conn).otherwise(back)


def without_repeats(conn: Column) -> Column:
    """Connectivity without vertices that repeat the one before (the first: the last), as padded or collapsed cells have them."""
    n = F.size(conn)
    before = lambda i: F.element_at(conn, F.when(i == 0, n).otherwise(i).cast("int"))
    return F.filter(conn, lambda v, i: v != before(i))


def type_of_size(conn: Column) -> Column:
    """The face type of a connectivity."""
    n = F.size(conn)
    return F.when(n == 3, model.TRI).when(n == 4, model.QUAD).otherwise(model.POLYGON)


def reflex_corner(points: Column) -> Column:
    """Place from 0 of the corner of a quadrilateral at which it turns the wrong way; null for convex ones."""
    out = F.lit(None).cast("int")
    for i in reversed(range(4)):
        a, b, c = V.at(points, (i + 3) % 4), V.at(points, i), V.at(points, (i + 1) % 4)
        out = F.when(a.cross(b).dot(c) < 0, i).otherwise(out)
    return out


def convex_parts(conn: Column, points: Column) -> Column:
    """A quadrilateral as it is, or as the two triangles at its reflex corner: an array of connectivities."""
    at = reflex_corner(points)
    turn = lambda k: F.element_at(conn, ((at + k) % 4 + 1).cast("int"))
    two = F.array(F.array(turn(0), turn(1), turn(2)), F.array(turn(0), turn(2), turn(3)))
    return F.when(at.isNull(), F.array(conn)).otherwise(two)
