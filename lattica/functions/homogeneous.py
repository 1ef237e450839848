"""Homogeneous whole-number coordinates ``(i, j, k, h)`` of structured boxes, and their transforms."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column


@dataclass(frozen=True)
class Coordinate:
    """A parameter triple; ``h`` is 1 for places and 0 for differences. Arithmetic is by component."""

    i: int
    j: int
    k: int = 0
    h: int = 1

    @property
    def ijk(self) -> tuple[int, int, int]:
        return self.i, self.j, self.k

    def _with(self, other: Coordinate, what) -> Coordinate:
        return Coordinate(*(what(a, b) for a, b in zip(self.ijk, other.ijk)))

    def __add__(self, o: Coordinate) -> Coordinate:
        return self._with(o, lambda a, b: a + b)

    def __sub__(self, o: Coordinate) -> Coordinate:
        return self._with(o, lambda a, b: a - b)

    def __mul__(self, n: int) -> Coordinate:
        return Coordinate(*(a * n for a in self.ijk))

    def __floordiv__(self, n: int) -> Coordinate:
        return Coordinate(*(a // n for a in self.ijk))

    def __neg__(self) -> Coordinate:
        return self * -1

    def cross(self, o: Coordinate) -> Coordinate:
        return Coordinate(self.j * o.k - self.k * o.j, self.k * o.i - self.i * o.k, self.i * o.j - self.j * o.i)

    def dot(self, o: Coordinate) -> int:
        return sum(a * b for a, b in zip(self.ijk, o.ijk))

    def squared(self) -> int:
        return self.dot(self)

    def normal(self) -> Coordinate:
        """Sign of each component."""
        return Coordinate(*((a > 0) - (a < 0) for a in self.ijk))

    def below(self, o: Coordinate) -> bool:
        return all(a <= b for a, b in zip(self.ijk, o.ijk))


@dataclass(frozen=True)
class Transform:
    """A rotation by quarter turns (and reflections) with a shift: rows act on ``(i, j, k, 1)``."""

    matrix: tuple[tuple[int, ...], ...] = ((1, 0, 0, 0), (0, 1, 0, 0), (0, 0, 1, 0), (0, 0, 0, 1))

    @classmethod
    def from_points(cls, old: tuple[Coordinate, Coordinate, Coordinate], new: tuple[Coordinate, Coordinate, Coordinate]) -> Transform:
        """The transform that moves three places, a corner and one along either of two directions, to three others."""

        def frame(p: tuple[Coordinate, ...]) -> np.ndarray:
            a, b = (p[1] - p[0]).normal(), (p[2] - p[0]).normal()
            return np.array([a.ijk, b.ijk, a.cross(b).ijk]).T

        turn = np.rint(frame(new) @ np.linalg.inv(frame(old))).astype(int)
        shift = np.array(new[0].ijk) - turn @ np.array(old[0].ijk)
        return cls((*(tuple(map(int, (*r, s))) for r, s in zip(turn, shift)), (0, 0, 0, 1)))

    def __call__(self, c: Coordinate) -> Coordinate:
        return Coordinate(*(int(sum(m * x for m, x in zip(row, (*c.ijk, c.h)))) for row in self.matrix[:3]), c.h)

    def columns(self, i: Column, j: Column, k: Column) -> tuple[Column, Column, Column]:
        """The same for columns."""
        return tuple(r[0] * i + r[1] * j + r[2] * k + r[3] for r in self.matrix[:3])

    def __matmul__(self, o: Transform) -> Transform:
        return Transform(tuple(tuple(map(int, r)) for r in np.array(self.matrix) @ np.array(o.matrix)))

    def inverse(self) -> Transform:
        return Transform(tuple(tuple(map(int, r)) for r in np.rint(np.linalg.inv(np.array(self.matrix))).astype(int)))
