"""Shape functions of elements in natural coordinates, vectorised over points.

Simplices use coordinates from 0 to 1, all others from -1 to 1. A shape gives the
weight of each node at a point, and their derivatives; elements made as products
of one direction's nodes (linear, quadratic, or spectral of any order) share one
rule.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cache

import numpy as np

from ..model import EDGE, HEX, QUAD, TET, TRI, MeshError
from . import numbering

Weights = Callable[[np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Shape:
    """``weights(x)`` is ``(points, nodes)``, ``gradient(x)`` is ``(points, nodes, directions)``; ``x`` has a column for each direction."""

    dim: int
    nodes: np.ndarray
    weights: Weights
    gradient: Weights
    simplex: bool = False

    def inside(self, x: np.ndarray, tolerance: float = 1e-6) -> np.ndarray:
        x = x[:, : self.dim]
        if self.simplex:
            return (x >= -tolerance).all(1) & (x.sum(1) <= 1 + tolerance)
        return (np.abs(x) <= 1 + tolerance).all(1)


def _simplex(dim: int) -> Shape:
    grad = np.vstack([-np.ones(dim), np.eye(dim)])
    weights = lambda x: np.column_stack([1 - x[:, :dim].sum(1), x[:, :dim]])
    return Shape(dim, np.vstack([np.zeros(dim), np.eye(dim)]), weights, lambda x: np.broadcast_to(grad, (len(x), *grad.shape)), True)


def lagrange(at: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and derivatives at ``x`` of the polynomials that are 1 at one of ``at`` and 0 at the others."""
    n = len(at)
    value, slope = np.ones((len(x), n)), np.zeros((len(x), n))
    for i in range(n):
        others = [j for j in range(n) if j != i]
        scale = np.prod([at[i] - at[j] for j in others])
        value[:, i] = np.prod([x - at[j] for j in others], axis=0) / scale
        slope[:, i] = sum(np.prod([x - at[j] for j in others if j != k], axis=0) * np.ones(len(x)) for k in others) / scale
    return value, slope


def _product(at: np.ndarray, places: np.ndarray) -> Shape:
    """Nodes at ``places`` (numbers of ``at`` in each direction) of a product of one direction's nodes."""
    dim = places.shape[1]

    def weights(x: np.ndarray) -> np.ndarray:
        return np.prod([lagrange(at, x[:, d])[0][:, places[:, d]] for d in range(dim)], axis=0)

    def gradient(x: np.ndarray) -> np.ndarray:
        parts = [lagrange(at, x[:, d]) for d in range(dim)]
        return np.stack([np.prod([parts[e][int(e == d)][:, places[:, e]] for e in range(dim)], axis=0) for d in range(dim)], 2)

    return Shape(dim, at[places], weights, gradient)


def lobatto(order: int) -> tuple[np.ndarray, np.ndarray]:
    """Gauss-Lobatto-Legendre nodes of an order, and their weights."""
    inner = np.polynomial.legendre.Legendre.basis(order).deriv().roots() if order > 1 else []
    at = np.array([-1.0, *np.sort(np.real(inner)), 1.0])
    at[np.abs(at) < 1e-14] = 0.0
    return at, 2 / (order * (order + 1) * np.polynomial.legendre.Legendre.basis(order)(at) ** 2)


# Corners of quadrilaterals and hexahedra in canonical order.
_RING = ((-1, -1), (1, -1), (1, 1), (-1, 1))
CORNERS = {EDGE: ((-1,), (1,)), QUAD: _RING, HEX: tuple((*c, k) for k in (-1, 1) for c in _RING)}


@cache
def shape(etype: int, kind: str = "linear", order: int = 2) -> Shape:
    """``linear``; ``quadratic`` (with the nodes of edges, faces and the middle, in canonical order); ``spectral`` of an order (the first direction fastest)."""
    if etype in (TRI, TET) and kind == "linear":
        return _simplex(2 if etype == TRI else 3)
    if etype not in CORNERS:
        raise MeshError("NOT_IMPLEMENTED", f"{kind} shape of type {etype}")
    corners = np.array(CORNERS[etype])
    dim = corners.shape[1]
    if kind == "linear":
        return _product(np.array([-1.0, 1.0]), (corners + 1) // 2)
    if kind == "quadratic":
        mids = [corners[list(local)].mean(0) for d in range(1, dim) for _, local in numbering.sides(etype, d)] + [np.zeros(dim)]
        return _product(np.array([-1.0, 0.0, 1.0]), np.vstack([corners, mids]).astype(int) + 1)
    if kind == "spectral":
        at = lobatto(order)[0]
        grid = np.meshgrid(*[np.arange(order + 1)] * dim, indexing="ij")
        return _product(at, np.column_stack([g.ravel(order="F") for g in grid]))
    raise MeshError("NOT_IMPLEMENTED", kind)


@cache
def rule(etype: int, points: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Gauss points of an element and their weights; on simplices by collapsing a box."""
    at, w = np.polynomial.legendre.leggauss(points)
    dim = {EDGE: 1, TRI: 2, QUAD: 2, TET: 3, HEX: 3}[etype]
    x = np.stack([g.ravel() for g in np.meshgrid(*[at] * dim, indexing="ij")], 1)
    weight = np.prod([g.ravel() for g in np.meshgrid(*[w] * dim, indexing="ij")], axis=0)
    if etype not in (TRI, TET):
        return x, weight
    u, weight = (x + 1) / 2, weight / 2**dim
    out, left = np.empty_like(u), np.ones(len(u))
    for d in range(dim):
        out[:, d] = u[:, d] * left
        weight = weight * left if d else weight
        left = left * (1 - u[:, d])
    return out, weight


def jacobians(s: Shape, x: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """``(points, 3, dim)``: derivatives of the position in elements with ``nodes`` of ``(points, nodes, 3)``."""
    return np.einsum("nkd,nkc->ncd", s.gradient(x), nodes)


def size_of(jac: np.ndarray) -> np.ndarray:
    """Volume (signed), area or length that a unit of natural coordinates takes."""
    if jac.shape[2] == 3:
        return np.linalg.det(jac)
    if jac.shape[2] == 2:
        return np.linalg.norm(np.cross(jac[:, :, 0], jac[:, :, 1]), axis=1)
    return np.linalg.norm(jac[:, :, 0], axis=1)


def settled(x: np.ndarray) -> np.ndarray:
    """Natural coordinates as far as iterations resolve them, in steps of 2**-40: what lies on a side or halfway does so exactly."""
    return np.round(x * 2.0**40) / 2.0**40


def reverse(s: Shape, points: np.ndarray, nodes: np.ndarray, rounds: int = 12, tolerance: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """Natural coordinates of points by Newton steps (least squares on surfaces), and whether they came to rest."""
    x = np.full((len(points), s.dim), 1 / (s.dim + 1) if s.simplex else -0.4)
    size = np.maximum(np.ptp(nodes, axis=1).max(1), 1e-300)
    rest = np.zeros(len(points), bool)
    for _ in range(rounds):
        miss = np.einsum("nk,nkc->nc", s.weights(x), nodes) - points
        jac = jacobians(s, x, nodes)
        square = np.einsum("ncd,nce->nde", jac, jac)
        flat = np.abs(np.linalg.det(square)) < 1e-30 * size ** (2 * s.dim)
        square[flat] = np.eye(s.dim)
        step = np.linalg.solve(square, np.einsum("ncd,nc->nd", jac, miss)[..., None])[..., 0]
        step[flat] = 0
        rest = (np.abs(step).max(1, initial=0) <= tolerance) & ~flat
        x = np.clip(x - step, -1e3, 1e3)
        if rest.all():
            break
    return settled(x), rest
