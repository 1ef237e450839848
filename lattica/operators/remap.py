"""Overlap of meshes and conservative remapping.

All pairs of cells whose boxes overlap are clipped convexly, in the plane or in
the gnomonic plane of a sphere; pieces keep both parents. Weights of a
first-order finite-volume map are overlap areas over target areas.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Mesh
from . import measures, spatial


def _padded(column: pa.Array, fields: str) -> np.ndarray:
    """Polygons of a batch as ``(rows, corners, fields)``; shorter ones repeat their last corner."""
    start, end = np.asarray(column.offsets)[:-1], np.asarray(column.offsets)[1:]
    most = int((end - start).max(initial=1))
    at = np.minimum(start[:, None] + np.arange(most), (end - 1)[:, None])
    flat = column.values
    return np.stack([flat.field(c).to_numpy(zero_copy_only=False)[at] for c in fields], 2)


def _held(points: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """The kept corners of each row, in order, then the last of them again; rows without any keep zeros."""
    count = keep.sum(1)
    order = np.argsort(~keep, axis=1, kind="stable")[:, : max(1, int(count.max(initial=0)))]
    at = np.take_along_axis(order, np.minimum(np.arange(order.shape[1]), np.maximum(count - 1, 0)[:, None]), 1)
    return np.take_along_axis(points, at[:, :, None], 1) * (count > 0)[:, None, None]


def planar_areas(p: np.ndarray) -> np.ndarray:
    """Signed areas of polygons ``(rows, corners, 2)``."""
    q = np.roll(p, -1, 1)
    return (p[:, :, 0] * q[:, :, 1] - q[:, :, 0] * p[:, :, 1]).sum(1) / 2


def _ccw(p: np.ndarray) -> np.ndarray:
    return np.where((planar_areas(p) >= 0)[:, None, None], p, p[:, ::-1])


def clip(subject: np.ndarray, window: np.ndarray, eps: float = 1e-12) -> np.ndarray:
    """The parts of polygons inside convex windows that run counter-clockwise, all rows at once, a window edge at a time.

    Both are ``(rows, corners, 2)``; what is cut away wholly comes out as zeros.
    """
    out = subject
    for k in range(window.shape[1]):
        a, b = window[:, k, None], window[:, (k + 1) % window.shape[1], None]
        q = np.roll(out, -1, 1)
        side = lambda p: (b[..., 0] - a[..., 0]) * (p[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (p[..., 0] - a[..., 0])  # noqa: E731, B023
        s, t = side(out), side(q)
        cross = ((s > eps) & (t < -eps)) | ((s < -eps) & (t > eps))
        u = np.where(cross, s / np.where(cross, s - t, 1.0), 0.0)[..., None]
        both = np.stack([out, out + u * (q - out)], 2).reshape(len(out), -1, 2)
        out = _held(both, np.stack([s >= -eps, cross], 2).reshape(len(out), -1))
    return out


def _overlap(source: Mesh, target: Mesh, margin: float, area) -> DataFrame:
    """``(source, target, area)`` of pairs whose boxes meet and whose ``area(p, q)``, of padded corners, is above 0."""
    pairs = spatial.box_overlap_pairs(spatial.bounds(source, 2), spatial.bounds(target, 2), margin)
    met = pairs.join(measures.corner_points(source, 2).select(F.col("handle").alias("a"), F.col("points").alias("p")), "a").join(measures.corner_points(target, 2).select(F.col("handle").alias("b"), F.col("points").alias("q")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                got = area(_padded(batch.column("p"), "xyz"), _padded(batch.column("q"), "xyz"))
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(got)], ["source", "target", "area"]).filter(pa.array(got > 0))

    return met.select("a", "b", "p", "q").mapInArrow(run, "source long, target long, area double")


def overlap_in_plane(source: Mesh, target: Mesh, least: float = 1e-12) -> DataFrame:
    """``(source, target, area)`` of all overlapping pairs of faces in the plane z = 0."""

    def area(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        got = planar_areas(clip(_ccw(p[:, :, :2]), _ccw(q[:, :, :2])))
        return np.where(got > least, got, 0.0)

    return _overlap(source, target, 0.0, area)


def spherical_areas(points: np.ndarray) -> np.ndarray:
    """Areas of polygons ``(rows, corners, 3)`` on the unit sphere by the fan from their first corners."""
    a, dot = points[:, 0], lambda u, v: (u * v).sum(1)
    total = np.zeros(len(points))
    for k in range(1, points.shape[1] - 1):
        b, c = points[:, k], points[:, k + 1]
        total += 2 * np.arctan2(dot(a, np.cross(b, c)), 1 + dot(a, b) + dot(b, c) + dot(c, a))
    return total


def clip_on_sphere(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Overlaps of pairs of convex spherical polygons ``(rows, corners, 3)``: clipped where great circles are straight lines.

    Rows that don't overlap, or of which a corner is not on the window's side of
    the sphere, come out as zeros.
    """
    center = q.mean(1)
    center /= np.linalg.norm(center, axis=1, keepdims=True)
    u = np.cross(center, np.eye(3)[np.abs(center).argmin(1)])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    v = np.cross(center, u)
    ahead = np.ones(len(p), bool)

    def flat(x: np.ndarray) -> np.ndarray:
        nonlocal ahead
        w = (x * center[:, None]).sum(2)
        ahead &= (w > 1e-9).all(1)
        w = np.where(w > 1e-9, w, 1.0)
        return _ccw(np.stack([(x * u[:, None]).sum(2) / w, (x * v[:, None]).sum(2) / w], 2))

    a, b = flat(p), flat(q)
    got = clip(a, b)
    ahead &= planar_areas(got) > 0
    back = center[:, None] + got[..., :1] * u[:, None] + got[..., 1:] * v[:, None]
    return back / np.linalg.norm(back, axis=2, keepdims=True) * ahead[:, None, None]


def overlap_on_sphere(source: Mesh, target: Mesh, least: float = 1e-14) -> DataFrame:
    """``(source, target, area)`` of overlapping faces on the unit sphere."""

    def area(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        got = np.abs(spherical_areas(clip_on_sphere(p, q)))
        return np.where(got > least, got, 0.0)

    return _overlap(source, target, 0.05, area)


def weights(overlap: DataFrame) -> DataFrame:
    """``(row, col, w)``: overlap area over the target cell's covered area."""
    whole = overlap.groupBy("target").agg(F.sum("area").alias("whole"))
    return overlap.join(whole, "target").select(F.col("target").alias("row"), F.col("source").alias("col"), (F.col("area") / F.col("whole")).alias("w"))


def apply(w: DataFrame, values: DataFrame) -> DataFrame:
    """``(entity, value)`` on the target: sums of weights times source values ``(entity, value)``."""
    return w.join(values.withColumnRenamed("entity", "col"), "col").groupBy(F.col("row").alias("entity")).agg(F.sum(F.col("w") * F.col("value")).alias("value"))


def properties(w: DataFrame, source_area: DataFrame, target_area: DataFrame, tolerance: float = 1e-10) -> DataFrame:
    """One row: whether a map is consistent (rows add to 1), conservative and monotone."""
    rows = w.groupBy("row").agg(F.sum("w").alias("s")).agg(F.bool_and(F.abs(F.col("s") - 1) <= tolerance).alias("consistent"))
    moved = w.join(target_area.withColumnRenamed("handle", "row").withColumnRenamed("area", "ta"), "row").groupBy("col").agg(F.sum(F.col("w") * F.col("ta")).alias("s"))
    cons = moved.join(source_area.withColumnRenamed("handle", "col"), "col").agg(F.bool_and(F.abs(F.col("s") - F.col("area")) <= tolerance).alias("conservative"))
    mono = w.agg(F.bool_and((F.col("w") >= -tolerance) & (F.col("w") <= 1 + tolerance)).alias("monotone"))
    return rows.crossJoin(cons).crossJoin(mono)  # one row each


def update_tracer(overlap: DataFrame, values: DataFrame, target_area: DataFrame) -> DataFrame:
    """``(handle, value)``: tracer moved from departure cells by overlap areas, over each arrival cell's area."""
    moved = overlap.join(values.withColumnRenamed("entity", "source"), "source").groupBy("target").agg(F.sum(F.col("area") * F.col("value")).alias("mass"))
    return moved.join(target_area.withColumnRenamed("handle", "target"), "target").select(F.col("target").alias("handle"), (F.col("mass") / F.col("area")).alias("value"))


def covering(source: Mesh, parts: DataFrame, target: Mesh) -> DataFrame:
    """``(part, handle)``: source cells that may meet what a part ``(handle, part)`` holds of the target, by the part's box."""
    held = spatial.bounds(target, 2).join(parts, "handle")
    box = held.groupBy("part").agg(*(F.min(f"{c}0").alias(f"{c}0") for c in "xyz"), *(F.max(f"{c}1").alias(f"{c}1") for c in "xyz"))
    pairs = spatial.box_overlap_pairs(spatial.bounds(source, 2), box.withColumn("handle", F.col("part").cast("long")))
    return pairs.select(F.col("b").alias("part"), F.col("a").alias("handle"))
