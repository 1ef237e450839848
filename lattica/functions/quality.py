"""Element quality metrics as column arithmetic over corner points.

``METRICS`` says which metrics exist for which type. Results are clamped to the
largest double; a reference size is needed by the relative-size family.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import EDGE, HEX, KNIFE, PRISM, PYRAMID, QUAD, TET, TRI, MeshError
from .geometry import V, det, tet_volume

LARGE, SMALL = 1.7976931348623157e308, 2.2250738585072014e-308


def _clamp(c: Column) -> Column:
    return F.least(F.lit(LARGE), F.greatest(F.lit(-LARGE), c))


def _ratio(top: Column, bottom: Column, otherwise: float = LARGE) -> Column:
    return F.when(F.abs(bottom) < SMALL, F.lit(otherwise)).otherwise(top / bottom)


def _extreme(values: list[Column], high: bool) -> Column:
    return (F.greatest if high else F.least)(*values) if len(values) > 1 else values[0]


def _degrees(c: Column) -> Column:
    return c * (180 / math.pi)


def _angle(u: V, v: V) -> Column:
    return _degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _ratio(u.dot(v), u.length() * v.length(), 0.0)))))


# edges ---------------------------------------------------------------------

def edge_length(p: list[V], size: Column | None = None) -> Column:
    return (p[1] - p[0]).length()


# triangles -----------------------------------------------------------------

def _tri(p: list[V]) -> tuple[V, V, V, list[Column], Column]:
    e = [p[1] - p[0], p[2] - p[1], p[0] - p[2]]
    return *e, [x.squared() for x in e], e[0].cross(p[2] - p[0]).length()


def tri_edge_ratio(p, size=None):
    *_, sq, _ = _tri(p)
    return F.sqrt(_ratio(_extreme(sq, True), _extreme(sq, False)))


def tri_aspect_ratio(p, size=None):
    *_, sq, twice = _tri(p)
    return _ratio(F.sqrt(_extreme(sq, True)) * sum((F.sqrt(s) for s in sq[1:]), F.sqrt(sq[0])), 2 * math.sqrt(3) * twice)


def tri_radius_ratio(p, size=None):
    *_, sq, twice = _tri(p)
    a, b, c = (F.sqrt(s) for s in sq)
    return _ratio(0.25 * a * b * c * (a + b + c), twice * twice)


def tri_aspect_frobenius(p, size=None):
    *_, sq, twice = _tri(p)
    return _ratio(sq[0] + sq[1] + sq[2], 2 * math.sqrt(3) * twice)


def tri_area(p, size=None):
    return _tri(p)[4] / 2


def _tri_angles(p: list[V]) -> list[Column]:
    return [_angle(p[(i + 1) % 3] - p[i], p[(i + 2) % 3] - p[i]) for i in range(3)]


def tri_minimum_angle(p, size=None):
    return _extreme(_tri_angles(p), False)


def tri_maximum_angle(p, size=None):
    return _extreme(_tri_angles(p), True)


def tri_condition(p, size=None):
    a, b = p[1] - p[0], p[2] - p[0]
    return _ratio(a.squared() + b.squared() - a.dot(b), a.cross(b).length() * math.sqrt(3))


def tri_scaled_jacobian(p, size=None):
    *_, sq, twice = _tri(p)
    n = [F.sqrt(s) for s in sq]
    return _ratio(2 / math.sqrt(3) * twice, _extreme([n[0] * n[1], n[1] * n[2], n[2] * n[0]], True), 0.0)


def tri_shape(p, size=None):
    return _ratio(F.lit(1.0), tri_condition(p), 0.0)


def _relative(measure: Column, size: Column | None) -> Column:
    if size is None:
        raise MeshError("FAILURE", "this metric needs a reference size")
    r = measure / size
    return F.when((measure <= 0) | (size <= 0), F.lit(0.0)).otherwise(F.least(r, 1 / r) ** 2)


def tri_relative_size(p, size=None):
    return _relative(tri_area(p), size)


def tri_shape_and_size(p, size=None):
    return tri_shape(p) * tri_relative_size(p, size)


# quadrilaterals --------------------------------------------------------------

def _quad_edges(p: list[V]) -> list[V]:
    return [p[(i + 1) % 4] - p[i] for i in range(4)]


def _principal(p: list[V]) -> tuple[V, V]:
    return p[1] + p[2] - p[0] - p[3], p[2] + p[3] - p[0] - p[1]


def _quad_signed(p: list[V]) -> list[Column]:
    """Signed corner areas, against the unit normal of the principal axes."""
    a, b = _principal(p)
    n = a.cross(b)
    size = n.length()
    e = _quad_edges(p)
    return [F.when(size < SMALL, F.lit(0.0)).otherwise(n.dot(e[(k + 3) % 4].cross(e[k])) / size) for k in range(4)]


def quad_edge_ratio(p, size=None):
    sq = [e.squared() for e in _quad_edges(p)]
    return F.sqrt(_ratio(_extreme(sq, True), _extreme(sq, False)))


def quad_max_edge_ratio(p, size=None):
    a, b = (v.length() for v in _principal(p))
    return F.greatest(_ratio(a, b), _ratio(b, a))


def quad_aspect_ratio(p, size=None):
    e = _quad_edges(p)
    n = [x.length() for x in e]
    return _ratio(F.lit(0.5) * (n[0] + n[1] + n[2] + n[3]) * _extreme(n, True), e[0].cross(e[1]).length() + e[2].cross(e[3]).length())


def quad_radius_ratio(p, size=None):
    sq = [e.squared() for e in _quad_edges(p)]
    d = [(p[2] - p[0]).squared(), (p[3] - p[1]).squared()]
    h = F.greatest(_extreme(sq, True), d[0], d[1])
    e = _quad_edges(p)
    areas = [e[0].cross(e[1]).length(), e[1].cross(e[2]).length(), e[2].cross(e[3]).length(), e[3].cross(e[0]).length()]
    return _ratio(F.sqrt((sq[0] + sq[1] + sq[2] + sq[3]) * h), 2 * math.sqrt(2) * _extreme(areas, False))


def _quad_frobenius(p: list[V]) -> list[Column]:
    e = _quad_edges(p)
    sq = [x.squared() for x in e]
    return [_ratio(sq[k] + sq[(k + 3) % 4], 2 * e[(k + 3) % 4].cross(e[k]).length()) for k in range(4)]


def quad_med_aspect_frobenius(p, size=None):
    f = _quad_frobenius(p)
    return (f[0] + f[1] + f[2] + f[3]) / 4


def quad_max_aspect_frobenius(p, size=None):
    return _extreme(_quad_frobenius(p), True)


def quad_skew(p, size=None):
    a, b = _principal(p)
    m = a.length() * b.length()
    return F.when(m < SMALL, F.lit(0.0)).otherwise(F.abs(a.dot(b) / m))


def quad_taper(p, size=None):
    a, b = _principal(p)
    c = (p[0] + p[2] - p[1] - p[3]).length()
    return _ratio(c, F.least(a.length(), b.length()))


def quad_warpage(p, size=None):
    e = _quad_edges(p)
    n = [e[(k + 3) % 4].cross(e[k]) for k in range(4)]
    m = [x.length() for x in n]
    flat = _extreme(m, False) < SMALL
    dots = [n[0].dot(n[2]) / (m[0] * m[2]), n[1].dot(n[3]) / (m[1] * m[3])]
    return F.when(flat, F.lit(SMALL)).otherwise(F.least(*dots) ** 3)


def quad_area(p, size=None):
    s = _quad_signed(p)
    return (s[0] + s[1] + s[2] + s[3]) / 4


def quad_stretch(p, size=None):
    sq = [e.squared() for e in _quad_edges(p)]
    d = F.greatest((p[2] - p[0]).squared(), (p[3] - p[1]).squared())
    return F.when(d < SMALL, F.lit(LARGE)).otherwise(math.sqrt(2) * F.sqrt(_extreme(sq, False) / d))


def quad_maximum_angle(p, size=None):
    return _extreme([_angle(p[(i + 1) % 4] - p[i], p[(i + 3) % 4] - p[i]) for i in range(4)], True)


def quad_oddy(p, size=None):
    out = []
    for i in range(4):
        a, b = p[(i + 1) % 4] - p[i], p[(i + 3) % 4] - p[i]
        ab, aa, bb = a.dot(b), a.squared(), b.squared()
        out.append(_ratio((aa - bb) ** 2 + 4 * ab * ab, 2 * (aa * bb - ab * ab)))
    return _extreme(out, True)


def quad_condition(p, size=None):
    s, e = _quad_signed(p), _quad_edges(p)
    return _extreme([F.when(s[k] < SMALL, F.lit(LARGE)).otherwise((e[k].squared() + e[(k + 3) % 4].squared()) / s[k]) for k in range(4)], True) * 0.5


def quad_jacobian(p, size=None):
    return _extreme(_quad_signed(p), False)


def quad_scaled_jacobian(p, size=None):
    s, n = _quad_signed(p), [e.length() for e in _quad_edges(p)]
    short = _extreme(n, False) < SMALL
    return F.when(short, F.lit(0.0)).otherwise(_extreme([s[k] / (n[k] * n[(k + 3) % 4]) for k in range(4)], False))


def quad_shear(p, size=None):
    return F.greatest(quad_scaled_jacobian(p), F.lit(0.0))


def quad_shape(p, size=None):
    s, sq = _quad_signed(p), [e.squared() for e in _quad_edges(p)]
    worst = _extreme([_ratio(s[k], sq[k] + sq[(k + 3) % 4], 0.0) for k in range(4)], False)
    return F.greatest(2 * worst, F.lit(0.0))


def quad_relative_size(p, size=None):
    return _relative(quad_area(p), size)


def quad_shape_and_size(p, size=None):
    return quad_shape(p) * quad_relative_size(p, size)


def quad_shear_and_size(p, size=None):
    return quad_shear(p) * quad_relative_size(p, size)


# tetrahedra ------------------------------------------------------------------

def _tet_edges(p: list[V]) -> list[V]:
    return [p[1] - p[0], p[2] - p[1], p[0] - p[2], p[3] - p[0], p[3] - p[1], p[3] - p[2]]


def _tet_surface(p: list[V]) -> list[Column]:
    return [((p[b] - p[a]).cross(p[c] - p[a])).length() / 2 for a, b, c in ((0, 1, 2), (0, 1, 3), (1, 2, 3), (0, 2, 3))]


def tet_edge_ratio(p, size=None):
    sq = [e.squared() for e in _tet_edges(p)]
    return F.sqrt(_ratio(_extreme(sq, True), _extreme(sq, False)))


def tet_jacobian(p, size=None):
    return det(p[1] - p[0], p[2] - p[0], p[3] - p[0])


def tet_scaled_jacobian(p, size=None):
    sq = [e.squared() for e in _tet_edges(p)]
    at = [sq[0] * sq[2] * sq[3], sq[0] * sq[1] * sq[4], sq[1] * sq[2] * sq[5], sq[3] * sq[4] * sq[5]]
    j = tet_jacobian(p)
    most = F.greatest(F.sqrt(_extreme(at, True)), F.abs(j))
    return F.when(most < SMALL, F.lit(LARGE)).otherwise(math.sqrt(2) * j / most)


def tet_volume_metric(p, size=None):
    return tet_volume(*p)


def _tet_circum(p: list[V]) -> Column:
    """Length of the vector whose part of ``12 volume`` is the circumradius."""
    a, b, c = p[1] - p[0], p[2] - p[0], p[3] - p[0]
    return (b.cross(c) * a.squared() + c.cross(a) * b.squared() + a.cross(b) * c.squared()).length()


def tet_radius_ratio(p, size=None):
    area = sum(_tet_surface(p)[1:], _tet_surface(p)[0])
    volume = tet_volume(*p)
    return F.when(F.abs(volume) < SMALL, F.lit(LARGE)).otherwise(_tet_circum(p) * area / (108 * volume * volume))


def tet_aspect_beta(p, size=None):
    area = sum(_tet_surface(p)[1:], _tet_surface(p)[0])
    volume = tet_volume(*p)
    return F.when(volume < SMALL, F.lit(LARGE)).otherwise(_tet_circum(p) * area / (108 * volume * volume))


def tet_aspect_ratio(p, size=None):
    area = sum(_tet_surface(p)[1:], _tet_surface(p)[0])
    longest = F.sqrt(_extreme([e.squared() for e in _tet_edges(p)], True))
    return _ratio(math.sqrt(6) / 36 * longest * area, F.abs(tet_volume(*p)))


def tet_aspect_gamma(p, size=None):
    sq = [e.squared() for e in _tet_edges(p)]
    rms = F.sqrt((sum(sq[1:], sq[0])) / 6)
    return _ratio(rms**3, F.abs(tet_volume(*p)) * (6 * math.sqrt(2)))


def _tet_frame(p: list[V]) -> tuple[Column, Column]:
    """Three halves of the squared frame against the ideal tetrahedron, and the Jacobian."""
    a, b, c = p[1] - p[0], p[2] - p[0], p[3] - p[0]
    return 1.5 * (a.squared() + b.squared() + c.squared()) - (a.dot(b) + b.dot(c) + c.dot(a)), tet_jacobian(p)


def tet_aspect_frobenius(p, size=None):
    top, j = _tet_frame(p)
    return F.when(j < SMALL, F.lit(LARGE)).otherwise(top / (3 * (math.sqrt(2) * j) ** (2 / 3)))


def tet_shape(p, size=None):
    top, j = _tet_frame(p)
    return F.when((j < SMALL) | (top < SMALL), F.lit(0.0)).otherwise(3 * (math.sqrt(2) * j) ** (2 / 3) / top)


def tet_minimum_angle(p, size=None):
    """Smallest dihedral angle, in degrees."""
    faces = [(p[b] - p[a]).cross(p[c] - p[a]) for a, b, c in ((0, 2, 1), (0, 1, 3), (1, 2, 3), (2, 0, 3))]
    out = [180.0 - _angle(faces[i], faces[j]) for i in range(4) for j in range(i + 1, 4)]
    return _extreme(out, False)


def tet_collapse_ratio(p, size=None):
    """Least height of a vertex over its face, against the face's longest edge, scaled to 1 for the ideal shape."""
    out = []
    for v, (a, b, c) in enumerate(((1, 2, 3), (0, 2, 3), (0, 1, 3), (0, 1, 2))):
        n = (p[b] - p[a]).cross(p[c] - p[a])
        longest = F.greatest(*((p[y] - p[x]).length() for x, y in ((a, b), (b, c), (c, a))))
        out.append(_ratio(F.abs(n.dot(p[v] - p[a])), n.length() * longest))
    return _extreme(out, False) * math.sqrt(1.5)


def tet_condition(p, size=None):
    a = p[1] - p[0]
    b = (p[2] * 2 - p[0] - p[1]) / math.sqrt(3)
    c = (p[3] * 3 - p[0] - p[1] - p[2]) / math.sqrt(6)
    d = det(a, b, c)
    top = F.sqrt((a.squared() + b.squared() + c.squared()) * (a.cross(b).squared() + b.cross(c).squared() + c.cross(a).squared()))
    return F.when(F.abs(d) < SMALL, F.lit(LARGE)).otherwise(top / (3 * d))


def tet_relative_size(p, size=None):
    return _relative(tet_volume(*p), size)


# hexahedra -------------------------------------------------------------------

# For each corner, the corners along its three edges, in right-handed order.
_HEX_CORNERS = ((1, 3, 4), (2, 0, 5), (3, 1, 6), (0, 2, 7), (7, 5, 0), (4, 6, 1), (5, 7, 2), (6, 4, 3))
_HEX_EDGES = ((0, 1), (1, 2), (2, 3), (3, 0), (4, 5), (5, 6), (6, 7), (7, 4), (0, 4), (1, 5), (2, 6), (3, 7))
_HEX_DIAGONALS = ((0, 6), (1, 7), (2, 4), (3, 5))


def _sum(p: list[V], plus: tuple[int, ...], minus: tuple[int, ...]) -> V:
    out = p[plus[0]]
    for i in plus[1:]:
        out = out + p[i]
    for i in minus:
        out = out - p[i]
    return out


def _hex_axes(p: list[V]) -> tuple[V, V, V]:
    return _sum(p, (1, 2, 5, 6), (0, 3, 4, 7)), _sum(p, (2, 3, 6, 7), (0, 1, 4, 5)), _sum(p, (4, 5, 6, 7), (0, 1, 2, 3))


def _hex_frames(p: list[V]) -> list[tuple[V, V, V]]:
    """Edge frames of the eight corners, then the principal axes."""
    return [(p[i] - p[c], p[j] - p[c], p[k] - p[c]) for c, (i, j, k) in enumerate(_HEX_CORNERS)]


def _hex_lengths(p: list[V]) -> list[Column]:
    return [(p[b] - p[a]).squared() for a, b in _HEX_EDGES]


def hex_edge_ratio(p, size=None):
    sq = _hex_lengths(p)
    return F.sqrt(_ratio(_extreme(sq, True), _extreme(sq, False)))


def hex_max_edge_ratio(p, size=None):
    n = [a.length() for a in _hex_axes(p)]
    return F.greatest(*(_ratio(n[i], n[j]) for i in range(3) for j in range(3) if i != j))


def hex_skew(p, size=None):
    a = _hex_axes(p)
    n = [x.length() for x in a]
    short = _extreme(n, False) <= SMALL
    return F.when(short, F.lit(0.0)).otherwise(F.greatest(*(F.abs(a[i].dot(a[j]) / (n[i] * n[j])) for i, j in ((0, 1), (0, 2), (1, 2)))))


def hex_taper(p, size=None):
    n = [x.length() for x in _hex_axes(p)]
    cross = [_sum(p, (0, 2, 4, 6), (1, 3, 5, 7)), _sum(p, (0, 3, 5, 6), (1, 2, 4, 7)), _sum(p, (0, 1, 6, 7), (2, 3, 4, 5))]
    pair = [F.least(n[0], n[1]), F.least(n[0], n[2]), F.least(n[1], n[2])]
    return F.greatest(*(_ratio(c.length(), m) for c, m in zip(cross, pair)))


def hex_volume_metric(p, size=None):
    return det(*_hex_axes(p)) / 64


def hex_stretch(p, size=None):
    longest = F.greatest(*((p[b] - p[a]).squared() for a, b in _HEX_DIAGONALS))
    return F.when(longest < SMALL, F.lit(LARGE)).otherwise(math.sqrt(3) * F.sqrt(_extreme(_hex_lengths(p), False) / longest))


def hex_diagonal(p, size=None):
    d = [(p[b] - p[a]).squared() for a, b in _HEX_DIAGONALS]
    return F.sqrt(_ratio(_extreme(d, False), _extreme(d, True)))


def _frame_jacobians(p: list[V]) -> list[Column]:
    return [det(*f) for f in _hex_frames(p)] + [det(*_hex_axes(p)) / 64]


def hex_jacobian(p, size=None):
    return _extreme(_frame_jacobians(p), False)


def hex_scaled_jacobian(p, size=None):
    out = [_ratio(det(*f), f[0].length() * f[1].length() * f[2].length()) for f in [*_hex_frames(p), _hex_axes(p)]]
    return _extreme(out, False)


def hex_shear(p, size=None):
    return F.greatest(_extreme([_ratio(det(*f), f[0].length() * f[1].length() * f[2].length(), 0.0) for f in _hex_frames(p)], False), F.lit(0.0))


def hex_shape(p, size=None):
    out = []
    for f in _hex_frames(p):
        d, sq = det(*f), f[0].squared() + f[1].squared() + f[2].squared()
        out.append(F.when((d <= SMALL) | (sq <= SMALL), F.lit(0.0)).otherwise(3 * F.greatest(d, F.lit(0.0)) ** (2 / 3) / sq))
    return _extreme(out, False)


def _hex_condition(p: list[V]) -> list[Column]:
    out = []
    for a, b, c in _hex_frames(p):
        d = det(a, b, c)
        top = F.sqrt((a.squared() + b.squared() + c.squared()) * (a.cross(b).squared() + b.cross(c).squared() + c.cross(a).squared()))
        out.append(F.when(d <= SMALL, F.lit(LARGE)).otherwise(top / (3 * d)))
    return out


def hex_condition(p, size=None):
    return _extreme(_hex_condition(p), True)


def hex_med_aspect_frobenius(p, size=None):
    c = _hex_condition(p)
    return sum(c[1:], c[0]) / 8


def hex_max_aspect_frobenius(p, size=None):
    return hex_condition(p)


def hex_oddy(p, size=None):
    out = []
    for f in [_hex_axes(p), *_hex_frames(p)]:
        g = [[x.dot(y) for y in f] for x in f]
        norm = sum((g[i][j] * g[i][j] for i in range(3) for j in range(3) if i or j), g[0][0] * g[0][0])
        trace, d = g[0][0] + g[1][1] + g[2][2], det(*f)
        out.append(F.when(d > SMALL, (norm - trace * trace / 3) / d ** (4 / 3)).otherwise(F.lit(LARGE)))
    return _extreme(out, True)


def hex_relative_size(p, size=None):
    return _relative(hex_volume_metric(p), size)


def hex_shape_and_size(p, size=None):
    return hex_shape(p) * hex_relative_size(p, size)


def hex_shear_and_size(p, size=None):
    return hex_shear(p) * hex_relative_size(p, size)


# other solids ----------------------------------------------------------------

def pyramid_volume(p, size=None):
    return tet_volume(p[0], p[1], p[3], p[4]) + tet_volume(p[1], p[2], p[3], p[4])


def wedge_volume(p, size=None):
    return tet_volume(p[0], p[1], p[2], p[3]) + tet_volume(p[1], p[4], p[5], p[3]) + tet_volume(p[1], p[5], p[2], p[3])


def knife_volume(p, size=None):
    return tet_volume(p[0], p[1], p[3], p[4]) + tet_volume(p[1], p[5], p[3], p[4]) + tet_volume(p[1], p[2], p[3], p[5]) + tet_volume(p[3], p[2], p[6], p[5])


Metric = Callable[[list[V], Column | None], Column]

METRICS: dict[int, dict[str, Metric]] = {
    EDGE: {"length": edge_length},
    TRI: {k: globals()[f"tri_{k}"] for k in ("edge_ratio", "aspect_ratio", "radius_ratio", "aspect_frobenius", "area", "minimum_angle", "maximum_angle", "condition", "scaled_jacobian", "shape", "relative_size", "shape_and_size")},
    QUAD: {k: globals()[f"quad_{k}"] for k in ("edge_ratio", "max_edge_ratio", "aspect_ratio", "radius_ratio", "med_aspect_frobenius", "max_aspect_frobenius", "skew", "taper", "warpage", "area", "stretch", "maximum_angle", "oddy", "condition", "jacobian", "scaled_jacobian", "shear", "shape", "relative_size", "shape_and_size", "shear_and_size")},
    TET: {k: globals()[f"tet_{k}"] for k in ("edge_ratio", "scaled_jacobian", "radius_ratio", "aspect_beta", "aspect_ratio", "aspect_gamma", "aspect_frobenius", "minimum_angle", "collapse_ratio", "condition", "jacobian", "shape", "relative_size")} | {"volume": tet_volume_metric},
    HEX: {k: globals()[f"hex_{k}"] for k in ("edge_ratio", "max_edge_ratio", "skew", "taper", "stretch", "diagonal", "oddy", "med_aspect_frobenius", "max_aspect_frobenius", "condition", "jacobian", "scaled_jacobian", "shear", "shape", "relative_size", "shape_and_size", "shear_and_size")} | {"volume": hex_volume_metric},
    PYRAMID: {"volume": pyramid_volume},
    PRISM: {"volume": wedge_volume},
    KNIFE: {"volume": knife_volume},
}


def available(etype: int) -> list[str]:
    """Metrics of a type."""
    return sorted(METRICS.get(etype, {}))


def register(etype: int, name: str, metric: Metric) -> None:
    """Add a metric of one's own: corner vectors and reference size to a column."""
    METRICS.setdefault(etype, {})[name] = metric


def measure(etype: int, name: str, points: Column, corners: int, size: Column | None = None) -> Column:
    """A metric over an array of point structs."""
    if name not in METRICS.get(etype, {}):
        raise MeshError("NOT_IMPLEMENTED", name)
    return _clamp(METRICS[etype][name]([V.at(points, i) for i in range(corners)], size))
