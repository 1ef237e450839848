"""Geometry as column arithmetic: vectors, measures, ray and distance tests, spherical areas."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


class V:
    """A vector of three columns."""

    def __init__(self, x: Column, y: Column, z: Column):
        self.x, self.y, self.z = x, y, z

    @classmethod
    def of(cls, prefix: str) -> V:
        """Fields ``x``, ``y`` and ``z`` of a struct column, or of a prefix ending in ``_``."""
        if prefix.endswith("_"):
            return cls(*(F.col(prefix + c) for c in "xyz"))
        return cls(*(F.col(f"{prefix}.{c}") for c in "xyz"))

    @classmethod
    def at(cls, points: Column, i: int) -> V:
        p = F.element_at(points, i + 1)
        return cls(p["x"], p["y"], p["z"])

    @classmethod
    def const(cls, x: float, y: float, z: float) -> V:
        return cls(*(F.lit(float(c)) for c in (x, y, z)))

    def __add__(self, o: V) -> V:
        return V(self.x + o.x, self.y + o.y, self.z + o.z)

    def __sub__(self, o: V) -> V:
        return V(self.x - o.x, self.y - o.y, self.z - o.z)

    def __mul__(self, s) -> V:
        return V(self.x * s, self.y * s, self.z * s)

    def __truediv__(self, s) -> V:
        return V(self.x / s, self.y / s, self.z / s)

    def dot(self, o: V) -> Column:
        return self.x * o.x + self.y * o.y + self.z * o.z

    def cross(self, o: V) -> V:
        return V(self.y * o.z - self.z * o.y, self.z * o.x - self.x * o.z, self.x * o.y - self.y * o.x)

    def squared(self) -> Column:
        return self.dot(self)

    def length(self) -> Column:
        return F.sqrt(self.dot(self))

    def unit(self) -> V:
        return self / self.length()

    def struct(self) -> Column:
        return F.struct(self.x.alias("x"), self.y.alias("y"), self.z.alias("z"))


def det(a: V, b: V, c: V) -> Column:
    return a.dot(b.cross(c))


def angle(a: V, b: V) -> Column:
    c = a.dot(b) / (a.length() * b.length())
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))


def triangle_area(a: V, b: V, c: V) -> Column:
    return (b - a).cross(c - a).length() / 2


def tet_volume(a: V, b: V, c: V, d: V) -> Column:
    """Signed: positive where ``d`` lies on the side that the normal of ``abc`` points to."""
    return det(b - a, c - a, d - a) / 6


def quad_area(a: V, b: V, c: V, d: V) -> Column:
    return triangle_area(a, b, c) + triangle_area(a, c, d)


def hex_volume(p: list[V]) -> Column:
    """By the five tetrahedra of a hexahedron."""
    parts = ((0, 1, 3, 4), (7, 3, 6, 4), (4, 5, 1, 6), (1, 6, 3, 4), (2, 6, 3, 1))
    return sum((tet_volume(*(p[i] for i in t)) for t in parts[1:]), tet_volume(*(p[i] for i in parts[0])))


def ray_triangle(origin: V, direction: V, a: V, b: V, c: V, limit: float | None = None) -> Column:
    """Distance along the ray (in units of ``direction``) to a triangle, edges included; null if it misses."""
    e1, e2 = a - b, a - c
    m = det(e1, e2, direction)
    r = a - origin
    beta, gamma, t = det(r, e2, direction) / m, det(e1, r, direction) / m, det(e1, e2, r) / m
    hit = (m != 0) & (beta >= 0) & (gamma >= 0) & (beta + gamma <= 1) & (t >= 0)
    if limit is not None:
        hit &= t <= limit
    return F.when(hit, t)


def ray_box(origin: V, direction: V, low: V, high: V, eps: float = 1e-12) -> Column:
    """``(enter, leave)`` of a ray and a box; null if it misses or the direction is zero."""
    enter, leave, ok = F.lit(0.0), F.lit(math.inf), F.lit(True)
    for o, d, lo, hi in zip((origin.x, origin.y, origin.z), (direction.x, direction.y, direction.z), (low.x, low.y, low.z), (high.x, high.y, high.z)):
        flat = F.abs(d) < eps
        t0, t1 = (lo - o) / d, (hi - o) / d
        enter = F.when(flat, enter).otherwise(F.greatest(enter, F.least(t0, t1)))
        leave = F.when(flat, leave).otherwise(F.least(leave, F.greatest(t0, t1)))
        ok &= ~flat | ((o >= lo) & (o <= hi))
    return F.when(ok & (enter <= leave) & (direction.squared() > 0), F.struct(enter.alias("enter"), leave.alias("leave")))


def segment_box(origin: V, direction: V, low: V, high: V, start: Column, end: Column) -> Column:
    """The part of a segment inside a box: ``(start, end)``, null if there is none."""
    s, e, ok = start, end, F.lit(True)
    for o, d, lo, hi in zip((origin.x, origin.y, origin.z), (direction.x, direction.y, direction.z), (low.x, low.y, low.z), (high.x, high.y, high.z)):
        t0, t1 = (lo - o) / d, (hi - o) / d
        s = F.when(d == 0, s).otherwise(F.greatest(s, F.least(t0, t1)))
        e = F.when(d == 0, e).otherwise(F.least(e, F.greatest(t0, t1)))
        ok &= (d != 0) | ((o >= lo) & (o <= hi))
    return F.when(ok & (s <= e), F.struct(s.alias("start"), e.alias("end")))


def closest_on_triangle(p: V, a: V, b: V, c: V) -> V:
    """The closest point of a triangle, by the region of the plane that ``p`` projects to."""
    ab, ac, ap, bp, cp = b - a, c - a, p - a, p - b, p - c
    d1, d2, d3, d4, d5, d6 = ab.dot(ap), ac.dot(ap), ab.dot(bp), ac.dot(bp), ab.dot(cp), ac.dot(cp)
    vc, vb, va = d1 * d4 - d3 * d2, d5 * d2 - d1 * d6, d3 * d6 - d5 * d4
    on_ab, on_ac = a + ab * (d1 / (d1 - d3)), a + ac * (d2 / (d2 - d6))
    on_bc = b + (c - b) * ((d4 - d3) / ((d4 - d3) + (d5 - d6)))
    inside = a + ab * (vb / (va + vb + vc)) + ac * (vc / (va + vb + vc))
    cases = [
        ((d1 <= 0) & (d2 <= 0), a), ((d3 >= 0) & (d4 <= d3), b), ((vc <= 0) & (d1 >= 0) & (d3 <= 0), on_ab),
        ((d6 >= 0) & (d5 <= d6), c), ((vb <= 0) & (d2 >= 0) & (d6 <= 0), on_ac), ((va <= 0) & (d4 - d3 >= 0) & (d5 - d6 >= 0), on_bc),
    ]

    def pick(name: str) -> Column:
        out = getattr(inside, name)
        for cond, v in reversed(cases):
            out = F.when(cond, getattr(v, name)).otherwise(out)
        return out

    return V(pick("x"), pick("y"), pick("z"))


def closest_on_box(p: V, low: V, high: V) -> V:
    return V(*(F.greatest(lo, F.least(hi, c)) for c, lo, hi in zip((p.x, p.y, p.z), (low.x, low.y, low.z), (high.x, high.y, high.z))))


def boxes_overlap(a_low: V, a_high: V, b_low: V, b_high: V, tolerance: float = 0.0) -> Column:
    out = F.lit(True)
    for c in "xyz":
        out &= (getattr(a_low, c) <= getattr(b_high, c) + tolerance) & (getattr(b_low, c) <= getattr(a_high, c) + tolerance)
    return out


def box_plane_overlap(normal: V, offset: Column, low: V, high: V) -> Column:
    """Whether the plane ``normal . p + offset = 0`` meets a box."""
    near = V(*(F.when(n < 0, hi).otherwise(lo) for n, lo, hi in zip((normal.x, normal.y, normal.z), (low.x, low.y, low.z), (high.x, high.y, high.z))))
    far = V(*(F.when(n < 0, lo).otherwise(hi) for n, lo, hi in zip((normal.x, normal.y, normal.z), (low.x, low.y, low.z), (high.x, high.y, high.z))))
    return (normal.dot(near) + offset <= 0) & (normal.dot(far) + offset >= 0)


def box_triangle_overlap(a: V, b: V, c: V, center: V, half: V, tolerance: float = 0.0) -> Column:
    """Separating-axis test of a triangle and a box: box axes, triangle normal, edge products."""
    p = [a - center, b - center, c - center]
    h = V(half.x + tolerance, half.y + tolerance, half.z + tolerance)
    edges = [p[1] - p[0], p[2] - p[1], p[0] - p[2]]
    out = F.lit(True)

    def apart(axis: V) -> Column:
        s = [axis.dot(q) for q in p]
        r = h.x * F.abs(axis.x) + h.y * F.abs(axis.y) + h.z * F.abs(axis.z)
        return (F.least(*s) > r) | (F.greatest(*s) < -r)

    unit = [V.const(1, 0, 0), V.const(0, 1, 0), V.const(0, 0, 1)]
    for u in unit:
        out &= ~apart(u)
    out &= ~apart(edges[0].cross(edges[1]))
    for u in unit:
        for e in edges:
            out &= ~apart(u.cross(e))
    return out


def solid_angle(p: V, a: V, b: V, c: V) -> Column:
    """Signed solid angle of a triangle seen from ``p``."""
    u, v, w = a - p, b - p, c - p
    x, y, z = u.length(), v.length(), w.length()
    return 2 * F.atan2(det(u, v, w), x * y * z + u.dot(v) * z + u.dot(w) * y + v.dot(w) * x)


def spherical_angle(a: V, b: V, c: V) -> Column:
    """Angle at ``b`` between the great circles to ``a`` and ``c``."""
    return angle(b.cross(a), b.cross(c))


def area_girard(points: list[V], radius: Column | float = 1.0) -> Column:
    """Area of a convex spherical polygon from its angles."""
    n = len(points)
    total = sum((spherical_angle(points[i - 1], points[i], points[(i + 1) % n]) for i in range(1, n)), spherical_angle(points[n - 1], points[0], points[1 % n]))
    return (total - (n - 2) * math.pi) * radius * radius


def area_lhuilier_triangle(a: V, b: V, c: V, radius: Column | float = 1.0) -> Column:
    """Signed area of a spherical triangle from its sides."""
    sides = [angle(b, c), angle(c, a), angle(a, b)]
    s = (sides[0] + sides[1] + sides[2]) / 2
    t = F.tan(s / 2) * F.tan((s - sides[0]) / 2) * F.tan((s - sides[1]) / 2) * F.tan((s - sides[2]) / 2)
    return F.signum(a.cross(b).dot(c)) * 4 * F.atan(F.sqrt(F.greatest(t, F.lit(0.0)))) * radius * radius


def area_lhuilier(points: list[V], radius: Column | float = 1.0) -> Column:
    """Area of a spherical polygon by the fan from its first vertex."""
    fan = [area_lhuilier_triangle(points[0], points[i], points[i + 1], radius) for i in range(1, len(points) - 1)]
    return sum(fan[1:], fan[0])


def great_circle(a: V, b: V, radius: Column | float = 1.0) -> Column:
    return angle(a, b) * radius


def gnomonic_plane(p: V) -> Column:
    """Which of the six planes of a cube a point projects to: +x 1, +y 2, -x 3, -y 4, -z 5, +z 6; ties go to z, then y."""
    ax, ay, az = F.abs(p.x), F.abs(p.y), F.abs(p.z)
    on_z = F.when(p.z < 0, 5).otherwise(6)
    on_y = F.when(p.y < 0, 4).otherwise(2)
    on_x = F.when(p.x < 0, 3).otherwise(1)
    return F.when((az >= ax) & (az >= ay), on_z).when(ay >= ax, on_y).otherwise(on_x)


def gnomonic(p: V, plane: Column, radius: float = 1.0) -> Column:
    """``(c1, c2)`` of a point on a plane."""
    a = F.when(plane.isin(1, 3), p.y / p.x * F.when(plane == 1, 1).otherwise(-1) * F.when(plane == 1, 1).otherwise(1)).when(plane.isin(2, 4), p.x / p.y * -1).otherwise(p.x / p.z * F.when(plane == 5, -1).otherwise(1))
    b = F.when(plane.isin(1, 3), p.z / F.abs(p.x)).when(plane.isin(2, 4), p.z / F.abs(p.y)).otherwise(p.y / F.abs(p.z))
    return F.struct((a * radius).alias("c1"), (b * radius).alias("c2"))


def smooth_field(lon: Column, lat: Column, centers: tuple[tuple[float, float], ...], bottom: float, top: float, radius: float) -> Column:
    """Cosine bells around centers, over a constant."""
    out = F.lit(bottom)
    for lon0, lat0 in reversed(centers):
        r = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), math.sin(lat0) * F.sin(lat) + math.cos(lat0) * F.cos(lat) * F.cos(lon - lon0))))
        out = F.when(r < radius, bottom + top * 0.5 * (1 + F.cos(math.pi * r / radius))).otherwise(out)
    return out


def slotted_cylinder(lon: Column, lat: Column, lon0: float, lat0: float, bottom: float, top: float, radius: float) -> Column:
    """A cylinder with a slot a sixth of its radius to either side of its middle."""
    r = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), math.sin(lat0) * F.sin(lat) + math.cos(lat0) * F.cos(lat) * F.cos(lon - lon0))))
    outside_slot = (F.abs(lon - lon0) >= radius / 6) | (lat - lat0 < -5.0 / 12 * radius)
    return F.when((r <= radius) & outside_slot, F.lit(top)).otherwise(F.lit(bottom))


def plucker_ray_triangle(origin: V, direction: V, a: V, b: V, c: V, orientation: int = 0) -> Column:
    """Distance along a ray to a triangle by Plucker edge tests, null if it misses.

    The sign of each edge's test comes from the edge itself, so two triangles
    that share an edge never both miss a ray between them. ``orientation`` 1
    keeps hits along the normal, -1 those against it.
    """

    def side(p: V, q: V) -> Column:
        return direction.dot((p - origin).cross(q - origin))

    s = [side(a, b), side(b, c), side(c, a)]
    plus, minus = (s[0] >= 0) & (s[1] >= 0) & (s[2] >= 0), (s[0] <= 0) & (s[1] <= 0) & (s[2] <= 0)
    total = s[0] + s[1] + s[2]
    ok = (total != 0) & (plus if orientation > 0 else minus if orientation < 0 else plus | minus)
    hit = (a * s[1] + b * s[2] + c * s[0]) / total
    t = (hit - origin).dot(direction) / direction.squared()
    return F.when(ok & (t >= 0), t)
