"""Streams of points against a static mesh."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..model import Mesh
from ..operators import fields


def locate_stream(points: DataFrame, mesh: Mesh, etype: int, values: DataFrame, sink: Callable[[DataFrame, int], None], method: str = "linear_fe"):
    """A writer that interpolates each micro-batch of ``points(pid, x, y, z)`` and hands it to ``sink``.

    The mesh is static, so each batch is an ordinary located join; ``sink`` gets
    the batch's number, by which it can be made idempotent.
    """
    return points.writeStream.foreachBatch(lambda batch, number: sink(fields.couple(mesh, batch, etype, values, method), number))
