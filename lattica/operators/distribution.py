"""Parts of a mesh: sharing, ownership, status bits, halos and partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model
from ..model import Mesh
from . import adjacency
from .fixpoint import store
from .ranges import ranked

# Status bits.
NOT_OWNED, SHARED, MULTISHARED, INTERFACE, GHOST = 1, 2, 4, 8, 16


def shared(copies: DataFrame) -> DataFrame:
    """``(gid, n_parts, owner)`` of ids ``(gid, part)`` that several parts have; the smallest part owns."""
    own = copies.select("gid", "part").distinct()
    return own.groupBy("gid").agg(F.count("*").alias("n_parts"), F.min("part").alias("owner")).filter("n_parts > 1")


def status(copies: DataFrame) -> DataFrame:
    """``(gid, part, status)`` of every copy."""
    own = copies.select("gid", "part").distinct()
    met = own.groupBy("gid").agg(F.count("*").alias("n"), F.min("part").alias("owner"))
    bits = F.when(F.col("part") != F.col("owner"), NOT_OWNED).otherwise(0) + F.when(F.col("n") > 1, SHARED | INTERFACE).otherwise(0) + F.when(F.col("n") > 2, MULTISHARED).otherwise(0)
    return own.join(met, "gid").select("gid", "part", bits.alias("status"))


def filter_status(rows: DataFrame, bits: int, op: str = "and") -> DataFrame:
    """Rows whose status has all bits (and), any (or) or none (not)."""
    met = F.col("status").bitwiseAND(F.lit(bits))
    return rows.filter({"and": met == bits, "or": met != 0, "not": met == 0}[op])


def shared_sets(values: DataFrame) -> DataFrame:
    """``(value, n_parts, owner)`` of set tags ``(part, value)`` that several parts have."""
    return shared(values.withColumnRenamed("value", "gid")).withColumnRenamed("gid", "value")


def ghosts(mesh: Mesh, parts: DataFrame, dim: int, bridge_dim: int, layers: int = 1) -> DataFrame:
    """``(part, handle)``: elements of other parts within so many layers over a bridge, for ``parts(handle, part)``."""
    near = store(mesh.spark, adjacency.neighbours(mesh, dim, bridge_dim))
    held = parts.select("part", F.col("handle").alias("elem"))
    front = held
    for _ in range(layers):
        new = front.join(near, "elem").select("part", F.col("other").alias("elem")).distinct().join(held, ["part", "elem"], "left_anti")
        front = store(mesh.spark, new)
        held = held.unionByName(front)
    return held.join(parts.select("part", F.col("handle").alias("elem")), ["part", "elem"], "left_anti").select("part", F.col("elem").alias("handle")).distinct()


def interface_vertices(mesh: Mesh, parts: DataFrame) -> DataFrame:
    """``(gid, part)`` of vertices used by elements of several parts."""
    used = mesh.incidence().join(parts.withColumnRenamed("handle", "elem"), "elem").select(F.col("vertex").alias("gid"), "part").distinct()
    return used.join(shared(used).select("gid"), "gid", "left_semi")


def part_neighbours(mesh: Mesh, parts: DataFrame) -> DataFrame:
    """``(part, other, n)``: parts that share vertices, and how many."""
    own = interface_vertices(mesh, parts)
    return own.join(own.withColumnRenamed("part", "other"), "gid").filter("part != other").groupBy("part", "other").agg(F.count("*").alias("n"))


def bisect(points: DataFrame, levels: int) -> DataFrame:
    """``(handle, part)``: recursive coordinate bisection, each level at the median of the longest side.

    The median is exact: half of a part's points, by coordinate and then handle,
    go to either side.
    """
    out = points.select("handle", "x", "y", "z", F.lit(0).cast("long").alias("part"))
    for _ in range(levels):
        box = out.groupBy("part").agg(*((F.max(c) - F.min(c)).alias(f"w{c}") for c in "xyz"))
        wide = out.join(box, "part")
        key = F.when((F.col("wx") >= F.col("wy")) & (F.col("wx") >= F.col("wz")), F.col("x")).when(F.col("wy") >= F.col("wz"), F.col("y")).otherwise(F.col("z"))
        placed = ranked(wide.select("handle", "x", "y", "z", "part", key.alias("_key")), ["part", "_key", "handle"], "_n")
        each = placed.groupBy("part").agg(F.min("_n").alias("_first"), F.count("*").alias("_all"))
        half = F.when((F.col("_n") - F.col("_first")) * 2 < F.col("_all"), 0).otherwise(1)
        out = placed.join(F.broadcast(each), "part").select("handle", "x", "y", "z", (F.col("part") * 2 + half).alias("part"))  # a row for each part
    return out.select("handle", "part")


def _spread(c: Column) -> Column:
    """Every third bit of a 16-bit number."""
    out = c.cast("long").bitwiseAND(F.lit(0xFFFF))
    # Masks of the bit-spreading steps.
    for shift, mask in ((16, 0x0000FF0000FF), (8, 0x00F00F00F00F), (4, 0x0C30C30C30C3), (2, 0x249249249249)):
        out = out.bitwiseOR(F.shiftleft(out, shift)).bitwiseAND(F.lit(mask))
    return out


def z_order(x: Column, y: Column, z: Column) -> Column:
    """Place along a Z-shaped space-filling curve of integer coordinates below 65536."""
    return _spread(x).bitwiseOR(F.shiftleft(_spread(y), 1)).bitwiseOR(F.shiftleft(_spread(z), 2))


def curve_partition(points: DataFrame, parts: int, cell: float) -> DataFrame:
    """``(handle, part)``: equal shares of points along the curve; a range partition, so no task sees all points.

    Shares are taken from the ranks within ranges of the curve.
    """
    low = points.agg(*(F.min(c).alias(c) for c in "xyz")).first()
    code = z_order(*(F.floor((F.col(c) - F.lit(low[c])) / cell) for c in "xyz"))
    coded = points.select("handle", code.alias("code"))
    if parts <= 1:
        return coded.select("handle", F.lit(0).cast("long").alias("part"))
    return ranked(coded, ["code", "handle"], "_n").select("handle", F.floor(F.col("_n") * parts / coded.count()).alias("part"))


def round_robin(elements: DataFrame, parts: int) -> DataFrame:
    """``(handle, part)`` by id."""
    return elements.select("handle", F.pmod(model.id_of(F.col("handle")), F.lit(parts)).alias("part"))


def merged_parts(copies: DataFrame, tolerance: float) -> DataFrame:
    """``(part, handle, gid)``: vertices ``(part, handle, x, y, z)`` of all parts that lie within a tolerance get one id, the smallest handle."""
    from .mutation import merge_map

    pairs = merge_map(copies.select("handle", "x", "y", "z"), tolerance)
    return copies.select("part", "handle").join(pairs, "handle", "left").select(F.col("part").cast("long").alias("part"), "handle", F.coalesce("keep", "handle").alias("gid"))


def migration(entities: DataFrame, sources: int, targets: int) -> DataFrame:
    """``(handle, source, target)``: entities in contiguous shares of one number of parts, and where they go in shares of another."""
    from .fields import spread

    one = spread(entities, sources).withColumnRenamed("part", "source")
    return one.join(spread(entities, targets).withColumnRenamed("part", "target"), "handle").select("handle", F.col("source").cast("long").alias("source"), F.col("target").cast("long").alias("target"))
