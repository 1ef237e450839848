"""Registered queries: every quality metric of triangles, quadrilaterals, tetrahedra and hexahedra, with SQL of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import model
from ..functions import quality
from ..operators import measures
from .queries_geometry import EDGES12, H8, HEXQ, Q4, QUADQ, T4, TETQ, _DIAG, d2, hexes, micro, quads, ratio, tets, tris, u
from .queries_tools import ORACLE as _TOOLS

QUERIES, ORACLE = {}, {}
Vector = list[str]


def minus(i: int, j: int) -> Vector:
    return [f"({c}{i}-{c}{j})" for c in "xyz"]


def named(n: str) -> Vector:
    return [f"{n}{c}" for c in "xyz"]


def cols(n: str, v: Vector) -> str:
    return ", ".join(f"{x} AS {n}{c}" for c, x in zip("xyz", v))


def dot(a: Vector, b: Vector) -> str:
    return "(" + " + ".join(f"{x}*{y}" for x, y in zip(a, b)) + ")"


def cross(a: Vector, b: Vector) -> Vector:
    return [f"({a[i]}*{b[j]} - {a[j]}*{b[i]})" for i, j in ((1, 2), (2, 0), (0, 1))]


def triple(a: Vector, b: Vector, c: Vector) -> str:
    return dot(a, cross(b, c))


def combined(plus: tuple[int, ...], less: tuple[int, ...]) -> Vector:
    return [f"({'+'.join(f'{c}{i}' for i in plus)}-{'-'.join(f'{c}{i}' for i in less)})" for c in "xyz"]


def least(*x: str) -> str:
    return f"least({', '.join(x)})"


def most(*x: str) -> str:
    return f"greatest({', '.join(x)})"


def relative(x: str) -> str:
    """Reference size 4."""
    return f"pow(least(({x}) / 4.0, 4.0 / ({x})), 2)"


def degrees(cosine: str) -> str:
    return f"degrees(acos(greatest(-1, least(1, {cosine}))))"


def every(name: str, etype: int, mesh, prefix: str, table: str, sql: dict[str, str]) -> None:
    names = quality.available(etype)
    assert sorted(sql) == names, set(names) ^ set(sql)
    QUERIES[name] = lambda s, d: measures.quality_of(mesh(s), etype, names, 4.0).select("handle", *(micro(F.col(c)).alias(c) for c in names))
    ORACLE[name] = f"{prefix} SELECT handle, {', '.join(f'{u(sql[n])} AS {n}' for n in names)} FROM {table}"


# triangles: the SQL stands with the other triangle queries
QUERIES["v02_tri_all"] = lambda s, d: measures.quality_of(tris(s), model.TRI, quality.available(model.TRI), 4.0).select("handle", *(micro(F.col(c)).alias(c) for c in quality.available(model.TRI)))
ORACLE["v02_tri_all"] = _TOOLS["v02_tri_every"]

# quadrilaterals -----------------------------------------------------------------------------
_e = [named(f"e{k}") for k in range(4)]
_quad = f"""{QUADQ}{Q4}, e AS (SELECT *, {', '.join(cols(f'e{k}', minus((k + 1) % 4, k)) for k in range(4))}, {cols('va', combined((1, 2), (0, 3)))}, {cols('vb', combined((2, 3), (0, 1)))}, {cols('t', combined((0, 2), (1, 3)))}, {d2(0, 2)} AS d0, {d2(1, 3)} AS d1 FROM pc),
f AS (SELECT *, {', '.join(cols(f'c{k}', cross(_e[(k + 3) % 4], _e[k])) for k in range(4))}, {cols('n', cross(named('va'), named('vb')))}, {', '.join(f'{dot(_e[k], _e[k])} AS s{k}' for k in range(4))}, sqrt({dot(named('va'), named('va'))}) AS la, sqrt({dot(named('vb'), named('vb'))}) AS lb FROM e),
g AS (SELECT *, {', '.join(f"sqrt({dot(named(f'c{k}'), named(f'c{k}'))}) AS m{k}, {dot(named('n'), named(f'c{k}'))} / sqrt({dot(named('n'), named('n'))}) AS j{k}, sqrt(s{k}) AS l{k}" for k in range(4))} FROM f)"""
_S, _Lq, _M, _J = ([f"{n}{k}" for k in range(4)] for n in "slmj")
_frob = [f"((s{k} + s{(k + 3) % 4}) / (2 * m{k}))" for k in range(4)]
_area = "((j0 + j1 + j2 + j3) / 4)"
_scaled = least(*(f"j{k} / (l{k} * l{(k + 3) % 4})" for k in range(4)))
_qshape = f"greatest(2 * {least(*(f'j{k} / (s{k} + s{(k + 3) % 4})' for k in range(4)))}, 0)"
# at corner k, edge k leaves and edge k + 3 arrives, so that the second side is the latter turned round
_ab = [f"(-{dot(_e[k], _e[(k + 3) % 4])})" for k in range(4)]
every("v03_quad_all", model.QUAD, quads, _quad, "g", {
    "edge_ratio": f"sqrt({most(*_S)} / {least(*_S)})", "max_edge_ratio": "greatest(la / lb, lb / la)",
    "aspect_ratio": f"0.5 * ({' + '.join(_Lq)}) * {most(*_Lq)} / (m1 + m3)", "radius_ratio": f"sqrt(({' + '.join(_S)}) * {most(*_S, 'd0', 'd1')}) / (2 * sqrt(2.0) * {least(*_M)})",
    "med_aspect_frobenius": f"({' + '.join(_frob)}) / 4", "max_aspect_frobenius": most(*_frob), "skew": f"abs({dot(named('va'), named('vb'))} / (la * lb))", "taper": f"sqrt({dot(named('t'), named('t'))}) / least(la, lb)",
    "warpage": f"pow(least({dot(named('c0'), named('c2'))} / (m0 * m2), {dot(named('c1'), named('c3'))} / (m1 * m3)), 3)", "area": _area, "stretch": f"sqrt(2.0) * sqrt({least(*_S)} / greatest(d0, d1))",
    "maximum_angle": most(*(degrees(f"{_ab[k]} / (l{k} * l{(k + 3) % 4})") for k in range(4))),
    "oddy": most(*(f"(pow(s{k} - s{(k + 3) % 4}, 2) + 4 * {_ab[k]} * {_ab[k]}) / (2 * (s{k} * s{(k + 3) % 4} - {_ab[k]} * {_ab[k]}))" for k in range(4))),
    "condition": f"0.5 * {most(*(f'(s{k} + s{(k + 3) % 4}) / j{k}' for k in range(4)))}", "jacobian": least(*_J), "scaled_jacobian": _scaled, "shear": f"greatest({_scaled}, 0)", "shape": _qshape,
    "relative_size": relative(_area), "shape_and_size": f"{_qshape} * {relative(_area)}", "shear_and_size": f"greatest({_scaled}, 0) * {relative(_area)}",
})

# tetrahedra -----------------------------------------------------------------------------------
_six = [(1, 0), (2, 1), (0, 2), (3, 0), (3, 1), (3, 2)]
_a, _b, _c = named("va"), named("vb"), named("vc")
_faces = {"f0": cross(minus(2, 0), minus(1, 0)), "f1": cross(minus(1, 0), minus(3, 0)), "f2": cross(minus(2, 1), minus(3, 1)), "f3": cross(minus(0, 2), minus(3, 2))}
_tet = f"""{TETQ}{T4}, e AS (SELECT *, {cols('va', minus(1, 0))}, {cols('vb', minus(2, 0))}, {cols('vc', minus(3, 0))}, {', '.join(f'{d2(i, j)} AS s{k}' for k, (i, j) in enumerate(_six))}, {', '.join(cols(n, v) for n, v in _faces.items())} FROM pc),
g AS (SELECT *, {triple(_a, _b, _c)} AS j, {', '.join(f"sqrt({dot(named(n), named(n))}) AS m{n}" for n in _faces)}, {dot(_a, _a)} AS aa, {dot(_b, _b)} AS bb, {dot(_c, _c)} AS cc FROM e)"""
_V = "(j / 6)"
_surface = "((mf0 + mf1 + mf2 + mf3) / 2)"
_circum = "sqrt(" + " + ".join(f"pow({p}*aa + {q}*bb + {r}*cc, 2)" for p, q, r in zip(cross(_b, _c), cross(_c, _a), cross(_a, _b))) + ")"
_S6 = [f"s{k}" for k in range(6)]
_frame = f"(1.5 * (aa + bb + cc) - ({dot(_a, _b)} + {dot(_b, _c)} + {dot(_c, _a)}))"
_cond = [[f"{x}" for x in _a], [f"((2*{q} - {p}) / sqrt(3.0))" for p, q in zip(_a, _b)], [f"((3*{r} - {p} - {q}) / sqrt(6.0))" for p, q, r in zip(_a, _b, _c)]]
_cc = [cross(_cond[0], _cond[1]), cross(_cond[1], _cond[2]), cross(_cond[2], _cond[0])]
_heights = {"f2": (1, 4, 5), "f3": (2, 3, 5), "f1": (0, 3, 4), "f0": (0, 1, 2)}
every("v04_tet_all", model.TET, tets, _tet, "g", {
    "edge_ratio": f"sqrt({most(*_S6)} / {least(*_S6)})", "jacobian": "j", "volume": _V,
    "scaled_jacobian": f"sqrt(2.0) * j / greatest(sqrt({most('s0*s2*s3', 's0*s1*s4', 's1*s2*s5', 's3*s4*s5')}), abs(j))",
    "radius_ratio": f"{_circum} * {_surface} / (108 * {_V} * {_V})", "aspect_beta": f"{_circum} * {_surface} / (108 * {_V} * {_V})",
    "aspect_ratio": f"sqrt(6.0) / 36 * sqrt({most(*_S6)}) * {_surface} / abs({_V})", "aspect_gamma": f"pow(sqrt(({' + '.join(_S6)}) / 6), 3) / (abs({_V}) * 6 * sqrt(2.0))",
    "aspect_frobenius": f"{_frame} / (3 * pow(sqrt(2.0) * j, 2.0/3))", "shape": f"3 * pow(sqrt(2.0) * j, 2.0/3) / {_frame}",
    "minimum_angle": least(*(f"180 - {degrees(f'{dot(named(p), named(q))} / (m{p} * m{q})')}" for i, p in enumerate(_faces) for q in list(_faces)[i + 1 :])),
    "collapse_ratio": f"sqrt(1.5) * {least(*(f'abs(j) / (m{n} * sqrt({most(*(f's{k}' for k in ks))}))' for n, ks in _heights.items()))}",
    "condition": f"sqrt(({' + '.join(dot(v, v) for v in _cond)}) * ({' + '.join(dot(v, v) for v in _cc)})) / (3 * {triple(*_cond)})", "relative_size": relative(_V),
})

# hexahedra: a row for the frame of each corner (and one for the principal axes), then one for each element ---------
_axes = [combined((1, 2, 5, 6), (0, 3, 4, 7)), combined((2, 3, 6, 7), (0, 1, 4, 5)), combined((4, 5, 6, 7), (0, 1, 2, 3))]
_rows = " UNION ALL ".join([f"SELECT handle, {k} AS corner, {cols('va', minus(i, k))}, {cols('vb', minus(j, k))}, {cols('vc', minus(m, k))} FROM pc" for k, (i, j, m) in enumerate(quality._HEX_CORNERS)] + [f"SELECT handle, 8, {cols('va', _axes[0])}, {cols('vb', _axes[1])}, {cols('vc', _axes[2])} FROM pc"])
_g2 = f"(aa*aa + bb*bb + cc*cc + 2*({dot(_a, _b)}*{dot(_a, _b)} + {dot(_b, _c)}*{dot(_b, _c)} + {dot(_c, _a)}*{dot(_c, _a)}))"
_crossed = " + ".join(dot(v, v) for v in (cross(_a, _b), cross(_b, _c), cross(_c, _a)))
_taper = [combined((0, 2, 4, 6), (1, 3, 5, 7)), combined((0, 3, 5, 6), (1, 2, 4, 7)), combined((0, 1, 6, 7), (2, 3, 4, 5))]
_n = [f"sqrt({dot(v, v)})" for v in _axes]
_pairs = [(0, 1), (0, 2), (1, 2)]
_hex = f"""{HEXQ}{H8}, fr AS ({_rows}), fm AS (SELECT *, {triple(_a, _b, _c)} AS d, {dot(_a, _a)} AS aa, {dot(_b, _b)} AS bb, {dot(_c, _c)} AS cc FROM fr),
fs AS (SELECT handle, min(CASE WHEN corner = 8 THEN d / 64 ELSE d END) AS jacobian, min(d / sqrt(aa*bb*cc)) AS scaled, min(CASE WHEN corner < 8 THEN d / sqrt(aa*bb*cc) END) AS shear,
 min(CASE WHEN corner < 8 THEN 3 * pow(d, 2.0/3) / (aa + bb + cc) END) AS shape, max(CASE WHEN corner < 8 THEN sqrt((aa + bb + cc) * ({_crossed})) / (3 * d) END) AS worst, avg(CASE WHEN corner < 8 THEN sqrt((aa + bb + cc) * ({_crossed})) / (3 * d) END) AS middle,
 max(({_g2} - pow(aa + bb + cc, 2) / 3) / pow(d, 4.0/3)) AS oddy, max(CASE WHEN corner = 8 THEN d / 64 END) AS volume FROM fm GROUP BY 1),
g AS (SELECT pc.*, fs.* EXCLUDE (handle) FROM pc JOIN fs USING (handle))"""
every("v05_hex_all", model.HEX, hexes, _hex, "g", {
    "edge_ratio": ratio(EDGES12), "max_edge_ratio": most(*(f"{_n[i]} / {_n[j]}" for i in range(3) for j in range(3) if i != j)),
    "skew": most(*(f"abs({dot(_axes[i], _axes[j])} / ({_n[i]} * {_n[j]}))" for i, j in _pairs)), "taper": most(*(f"sqrt({dot(v, v)}) / {least(_n[i], _n[j])}" for v, (i, j) in zip(_taper, _pairs))),
    "stretch": f"sqrt(3.0) * sqrt({least(*EDGES12)} / {most(*_DIAG)})", "diagonal": f"sqrt({least(*_DIAG)} / {most(*_DIAG)})", "volume": "volume", "jacobian": "jacobian", "scaled_jacobian": "scaled",
    "shear": "greatest(shear, 0)", "shape": "shape", "condition": "worst", "max_aspect_frobenius": "worst", "med_aspect_frobenius": "middle", "oddy": "oddy",
    "relative_size": relative("volume"), "shape_and_size": f"shape * {relative('volume')}", "shear_and_size": f"greatest(shear, 0) * {relative('volume')}",
})
