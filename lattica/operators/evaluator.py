"""Evaluation of fields in elements: values, Jacobians, integrals, inverse maps, normals, containment.

Elements travel with their nodes (and nodal values), and all rows of a batch are
evaluated at once in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import model
from ..functions import shapes
from ..model import Mesh
from . import spatial

_AT = ("xi", "eta", "zeta")


def _stack(column: pa.Array, n: int, width: int) -> np.ndarray:
    flat = column.flatten()
    if width == 1:
        return flat.to_numpy(zero_copy_only=False).reshape(-1, n)
    return np.stack([flat.field(c).to_numpy(zero_copy_only=False) for c in "xyz"], 1).reshape(-1, n, 3)


def _natural(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in _AT], 1)


@dataclass(frozen=True)
class Evaluator:
    """Elements of one type of a mesh, with a kind of shape functions (``linear``, ``quadratic``, ``spectral``).

    Spectral elements keep their geometry by corners; their nodal values are an
    array for each element.
    """

    mesh: Mesh
    etype: int
    kind: str = "linear"
    order: int = 2

    @property
    def shape(self) -> shapes.Shape:
        return shapes.shape(self.etype, self.kind, self.order)

    @property
    def geometry(self) -> shapes.Shape:
        return shapes.shape(self.etype, "linear" if self.kind == "spectral" else self.kind, self.order)

    def _nodes(self, values: DataFrame | None = None) -> DataFrame:
        """``(handle, points, values)``; values of vertices in order of connectivity, or the element's own array."""
        n = len(self.geometry.nodes)
        own = self.mesh.elements.filter(model.of_type(F.col("handle"), self.etype)).filter(F.size("conn") >= n)
        inc = own.select("handle", F.posexplode(F.slice("conn", 1, n)).alias("pos", "vertex"))
        at = inc.join(self.mesh.vertices.withColumnRenamed("handle", "vertex"), "vertex")
        fields = [F.struct("x", "y", "z").alias("p")]
        per_vertex = values is not None and self.kind != "spectral"
        if per_vertex:
            at = at.join(values.withColumnRenamed("entity", "vertex"), "vertex")
            fields.append(F.col("value").cast("double").alias("v"))
        rows = at.groupBy("handle").agg(F.array_sort(F.collect_list(F.struct("pos", *fields))).alias("s")).filter(F.size("s") == n)
        out = rows.select("handle", F.transform("s", lambda s: s["p"]).alias("points"), *([F.transform("s", lambda s: s["v"]).alias("values")] if per_vertex else []))
        if values is not None and not per_vertex:
            out = out.join(values.select(F.col("entity").alias("handle"), F.col("value").alias("values")), "handle")
        return out

    def evaluate(self, located: DataFrame, values: DataFrame) -> DataFrame:
        """``(pid, value)`` of a field, given at vertices ``(entity, value)``, at ``located(pid, handle, xi, eta, zeta)``."""
        shape, n = self.shape, len(self.shape.nodes)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    got = (shape.weights(_natural(batch)) * _stack(batch.column("values"), n, 1)).sum(1)
                    yield pa.RecordBatch.from_arrays([batch.column("pid"), pa.array(got)], ["pid", "value"])

        return located.join(self._nodes(values), "handle").select("pid", *_AT, "values").mapInArrow(run, "pid long, value double")

    def jacobian(self, located: DataFrame) -> DataFrame:
        """``(pid, jacobian)``: determinant (of surfaces: area) of the map from natural coordinates."""
        shape, n = self.geometry, len(self.geometry.nodes)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    got = shapes.size_of(shapes.jacobians(shape, _natural(batch), _stack(batch.column("points"), n, 3)))
                    yield pa.RecordBatch.from_arrays([batch.column("pid"), pa.array(got)], ["pid", "jacobian"])

        return located.join(self._nodes(), "handle").select("pid", *_AT, "points").mapInArrow(run, "pid long, jacobian double")

    def integrate(self, values: DataFrame, points: int = 3) -> DataFrame:
        """``(handle, integral)`` of a field by Gauss points; a spectral field by its own nodes."""
        shape, geometry, n, m = self.shape, self.geometry, len(self.shape.nodes), len(self.geometry.nodes)
        x, w = shapes.rule(self.etype, points)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not len(batch):
                    continue
                nodes, held = _stack(batch.column("points"), m, 3), _stack(batch.column("values"), n, 1)
                total = np.zeros(len(batch))
                for at, weight in zip(x, w):
                    here = np.broadcast_to(at, (len(batch), len(at)))
                    total += weight * shapes.size_of(shapes.jacobians(geometry, here, nodes)) * (shape.weights(here) * held).sum(1)
                yield pa.RecordBatch.from_arrays([batch.column("handle"), pa.array(total)], ["handle", "integral"])

        return self._nodes(values).select("handle", "points", "values").mapInArrow(run, "handle long, integral double")

    def reverse(self, pairs: DataFrame, tolerance: float = 1e-6) -> DataFrame:
        """``(pid, handle, xi, eta, zeta, inside)`` of points ``(pid, handle, x, y, z)`` in their elements."""
        shape, n = self.geometry, len(self.geometry.nodes)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not len(batch):
                    continue
                p = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in "xyz"], 1)
                nodes = _stack(batch.column("points"), n, 3)
                x, rest = shapes.reverse(shape, p, nodes)
                near = np.linalg.norm(np.einsum("nk,nkc->nc", shape.weights(x), nodes) - p, axis=1) <= tolerance * np.maximum(1, np.ptp(nodes, axis=1).max(1))
                full = np.zeros((len(p), 3))
                full[:, : shape.dim] = x
                yield pa.RecordBatch.from_arrays([batch.column("pid"), batch.column("handle"), *(pa.array(full[:, k]) for k in range(3)), pa.array(rest & near & shape.inside(x, tolerance))], ["pid", "handle", *_AT, "inside"])

        return pairs.join(self._nodes(), "handle").select("pid", "handle", *"xyz", "points").mapInArrow(run, "pid long, handle long, xi double, eta double, zeta double, inside boolean")

    def containing(self, points: DataFrame, tolerance: float = 1e-6) -> DataFrame:
        """``(pid, handle, xi, eta, zeta)``: the element that each point lies in, the smallest handle among several.

        An element that holds a point goes before those that hold it by the tolerance only.
        """
        own = self.mesh.with_(elements=self.mesh.elements.filter(model.of_type(F.col("handle"), self.etype)))
        met = spatial.candidates(points, spatial.bounds(own, model.DIMENSIONS[self.etype]), tolerance).select("pid", "handle", *"xyz")
        found = self.reverse(met, tolerance).filter("inside")
        at = [F.col(c) for c in _AT]
        out = F.greatest(*(-c for c in at), at[0] + at[1] + at[2] - 1) if self.geometry.simplex else F.greatest(*map(F.abs, at)) - 1
        return spatial.innermost(found, out)

    def normals(self, located: DataFrame) -> DataFrame:
        """``(pid, x, y, z)``: unit normals of faces at points."""
        shape, n = self.geometry, len(self.geometry.nodes)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    jac = shapes.jacobians(shape, _natural(batch), _stack(batch.column("points"), n, 3))
                    up = np.cross(jac[:, :, 0], jac[:, :, 1])
                    up /= np.maximum(np.linalg.norm(up, axis=1, keepdims=True), 1e-300)
                    yield pa.RecordBatch.from_arrays([batch.column("pid"), *(pa.array(np.ascontiguousarray(up[:, k])) for k in range(3))], ["pid", *"xyz"])

        return located.join(self._nodes(), "handle").select("pid", *_AT, "points").mapInArrow(run, "pid long, x double, y double, z double")

    def interpolate(self, points: DataFrame, values: DataFrame) -> DataFrame:
        """``(pid, value)`` at points ``(pid, x, y, z)`` wherever they lie; those in no element give no row."""
        return self.evaluate(self.containing(points), values)


def spherical(mesh: Mesh, points: DataFrame, values: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """``(pid, value)`` on quadrilaterals of a sphere: bilinear where rays from the center meet the flat element."""
    shape = shapes.shape(model.QUAD)
    margin = 0.05
    box = spatial.bounds(mesh, 2)
    met = spatial.candidates(points, box, margin).select("pid", "handle", *"xyz")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            p = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in "xyz"], 1)
            nodes = _stack(batch.column("points"), 4, 3)
            up = nodes.mean(1)
            up /= np.linalg.norm(up, axis=1, keepdims=True)
            ahead = (p * up).sum(1) > 0
            scale = lambda q: q / np.maximum((q * up[:, None]).sum(2, keepdims=True), 1e-12)
            x, rest = shapes.reverse(shape, scale(p[:, None])[:, 0], scale(nodes))
            value = (shape.weights(x) * _stack(batch.column("values"), 4, 1)).sum(1)
            keep = pa.array(ahead & rest & shape.inside(x, tolerance))
            yield pa.RecordBatch.from_arrays([batch.column("pid"), batch.column("handle"), pa.array(value)], ["pid", "handle", "value"]).filter(keep)

    found = met.join(Evaluator(mesh, model.QUAD)._nodes(values), "handle").select("pid", "handle", *"xyz", "points", "values").mapInArrow(run, "pid long, handle long, value double")
    return found.groupBy("pid").agg(F.min(F.struct("handle", "value")).alias("m")).select("pid", "m.value")
