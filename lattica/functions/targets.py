"""Target-matrix and size-shape metrics of tetrahedra, as columns, and their combination.

A tetrahedron's edges from its first corner are the columns of A. T = A W^-1
compares it with a target element W; metrics of T are 0 (or 1) where A is W up to
what the metric leaves free: size, orientation, or neither.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import V, det

Matrix = list[list[Column]]

#: Columns of the target: the regular tetrahedron with edges of length 1.
REGULAR = ((1.0, 0.5, 0.5), (0.0, math.sqrt(3) / 2, math.sqrt(3) / 6), (0.0, 0.0, math.sqrt(2 / 3)))


def inverse(w: tuple[tuple[float, ...], ...]) -> list[list[float]]:
    """Inverse of a 3 by 3 matrix by cofactors."""
    c = [[w[(i + 1) % 3][(j + 1) % 3] * w[(i + 2) % 3][(j + 2) % 3] - w[(i + 1) % 3][(j + 2) % 3] * w[(i + 2) % 3][(j + 1) % 3] for j in range(3)] for i in range(3)]
    d = sum(w[0][j] * c[0][j] for j in range(3))
    return [[c[j][i] / d for j in range(3)] for i in range(3)]


def edges(p: list[V]) -> Matrix:
    """A: rows are x, y and z, columns the edges from the first corner."""
    e = [q - p[0] for q in p[1:4]]
    return [[getattr(v, c) for v in e] for c in "xyz"]


def relative(p: list[V], target: tuple[tuple[float, ...], ...] = REGULAR) -> Matrix:
    """T = A W^-1."""
    a, w = edges(p), inverse(target)
    return [[sum((a[i][k] * w[k][j] for k in (1, 2)), a[i][0] * w[0][j]) for j in range(3)] for i in range(3)]


def determinant(t: Matrix) -> Column:
    return det(*(V(t[0][j], t[1][j], t[2][j]) for j in range(3)))


def squared(t: Matrix) -> Column:
    """Sum of squares of all entries."""
    every = [x * x for row in t for x in row]
    return sum(every[1:], every[0])


def adjugate(t: Matrix) -> Matrix:
    return [[t[(j + 1) % 3][(i + 1) % 3] * t[(j + 2) % 3][(i + 2) % 3] - t[(j + 1) % 3][(i + 2) % 3] * t[(j + 2) % 3][(i + 1) % 3] for j in range(3)] for i in range(3)]


def _minus_unit(t: Matrix) -> Matrix:
    return [[x - 1.0 if i == j else x for j, x in enumerate(row)] for i, row in enumerate(t)]


def _trace(t: Matrix) -> Column:
    return t[0][0] + t[1][1] + t[2][2]


def _barrier(tau: Column, value: Column) -> Column:
    """Metrics with a barrier have no value for inverted elements."""
    return F.when(tau > 0, value)


_ROOT3 = math.sqrt(3)
#: Metrics of T; those named ``barrier`` grow without bound as an element degenerates.
TARGET: dict[str, Callable[[Matrix], Column]] = {
    "size": lambda t: (determinant(t) - 1) ** 2,
    "size_barrier": lambda t: _barrier(d := determinant(t), d + 1 / d - 2),
    "shape": lambda t: F.pow(squared(t), 1.5) - 3 * _ROOT3 * determinant(t),
    "shape_barrier": lambda t: _barrier(d := determinant(t), F.pow(F.sqrt(squared(t)) / _ROOT3, 3) / d - 1),
    "shape_inverse_barrier": lambda t: _barrier(d := determinant(t), squared(t) * squared(adjugate(t)) / (9 * d * d) - 1),
    "shape_orient": lambda t: F.sqrt(squared(t)) - _trace(t) / _ROOT3,
    "shape_orient_barrier": lambda t: _barrier(d := determinant(t), (F.sqrt(squared(t)) - _trace(t) / _ROOT3) / (2 * d)),
    "shape_size_barrier": lambda t: _barrier(d := determinant(t), F.pow(squared(t), 1.5) - 3 * _ROOT3 * F.log(d) - 3 * _ROOT3),
    "shape_size_orient": lambda t: squared(_minus_unit(t)),
    "shape_size_orient_barrier": lambda t: _barrier(d := determinant(t), squared(_minus_unit(t)) / (2 * d)),
    "untangle": lambda t: (F.abs(d := determinant(t)) - d) / 2,
}


def _cube_root_squared(d: Column) -> Column:
    return F.pow(F.greatest(d, F.lit(0.0)), 2 / 3)


#: Metrics of a tetrahedron by itself, against the regular one.
ELEMENT: dict[str, Callable[[Matrix], Column]] = {
    "mean_ratio": lambda t: 3 * _cube_root_squared(determinant(t)) / squared(t),
    "inverse_mean_ratio": lambda t: _barrier(d := determinant(t), squared(t) / (3 * _cube_root_squared(d))),
    "condition_number": lambda t: _barrier(d := determinant(t), F.sqrt(squared(t) * squared(adjugate(t))) / (3 * d)),
    "untangle_beta": lambda t: (F.abs(d := determinant(t) - 0.001) - d) / 2,
}


def aspect_ratio_gamma(p: list[V]) -> Column:
    """Mean square edge, cubed, over the volume: 1 for a regular tetrahedron."""
    pairs = [(i, j) for i in range(4) for j in range(i)]
    mean = sum(((p[i] - p[j]).squared() for i, j in pairs[1:]), (p[pairs[0][0]] - p[pairs[0][1]]).squared()) / 6
    return F.pow(mean, 1.5) / (determinant(edges(p)) * math.sqrt(2))


def local_size(p: list[V]) -> Column:
    """Smallest over mean of the volumes at the corners: 1 for any tetrahedron, whose corners all have its own volume."""
    corners = [F.abs(det(p[(i + 1) % 4] - p[i], p[(i + 2) % 4] - p[i], p[(i + 3) % 4] - p[i])) for i in range(4)]
    return F.least(*corners) * 4 / (corners[0] + corners[1] + corners[2] + corners[3])


# combinations -------------------------------------------------------------------

def added(*metrics: Column) -> Column:
    return sum(metrics[1:], metrics[0])


def multiplied(*metrics: Column) -> Column:
    return math.prod(metrics[1:], start=metrics[0])


def powered(metric: Column, power: float) -> Column:
    return F.pow(metric, F.lit(float(power)))


def scaled(metric: Column, factor: float) -> Column:
    return metric * factor


# objective functions: one number for a metric over all elements ------------------------

def objective(kind: str, metric: Column, power: float = 2.0) -> Column:
    """An aggregate of a metric: ``lp`` (sum of powers), ``pmean``, ``max``, ``linf``, ``deviation``, ``variance``."""
    raised = F.pow(F.abs(metric), F.lit(float(power)))
    return {
        "lp": F.sum(raised), "pmean": F.pow(F.avg(raised), F.lit(1 / power)), "max": F.max(metric),
        "linf": F.max(F.abs(metric)), "deviation": F.stddev_pop(metric), "variance": F.var_pop(metric),
    }[kind]
