"""Trees over boxes as tables of nodes and leaf members: splitting planes, bounding volumes, oriented boxes.

A tree is grown level by level: all nodes of a level split in one pass over their
members, so no task sees a whole tree. Nodes are numbered from 1; the children of
n are 2n and 2n + 1.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spatial
from .fixpoint import store
from .ranges import ranked

_BOX = [f"{c}{i}" for i in (0, 1) for c in "xyz"]


@dataclass(frozen=True)
class Tree:
    """``nodes(node, depth, x0 .. z1, n, leaf)`` and ``members(node, handle)`` of the leaves.

    Boxes of a plane tree tile the root's; those of a volume tree bound the members.
    """

    nodes: DataFrame
    members: DataFrame
    boxes: DataFrame

    def leaves(self) -> DataFrame:
        return self.nodes.filter("leaf")

    def parent(self) -> DataFrame:
        """``(node, parent, sibling)`` of all nodes but the root."""
        n = F.col("node")
        return self.nodes.filter("node > 1").select("node", F.floor(n / 2).alias("parent"), n.bitwiseXOR(F.lit(1).cast("long")).alias("sibling"))

    def volume(self) -> DataFrame:
        """``(node, volume)`` of each node's box."""
        return self.nodes.select("node", ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) * (F.col("z1") - F.col("z0"))).alias("volume"))

    def info(self) -> DataFrame:
        """One row: nodes, leaves, least and largest depth of a leaf, members in all leaves and in the largest."""
        leaf = F.col("leaf")
        depth, n = F.when(leaf, F.col("depth")), F.when(leaf, F.col("n"))
        return self.nodes.agg(F.count("*").alias("nodes"), F.count(depth).alias("leaves"), F.min(depth).alias("low"), F.max(depth).alias("high"), F.sum(n).alias("members"), F.max(n).alias("largest"))

    def leaf_of(self, points: DataFrame) -> DataFrame:
        """``(pid, node)``: the leaf of a plane tree that each point of the root's box lies in; on a plane, the lower numbered one."""
        leaves = self.leaves().select(F.col("node").alias("handle"), *_BOX)
        return spatial.candidates(points, leaves).groupBy("pid").agg(F.min("handle").alias("node"))

    def near(self, points: DataFrame, reach: float) -> DataFrame:
        """``(pid, node)``: leaves whose boxes come as close to points as ``reach``."""
        leaves = self.leaves().select(F.col("node").alias("handle"), *_BOX)
        far = sum(F.pow(F.greatest(F.col(f"{c}0") - F.col(c), F.col(c) - F.col(f"{c}1"), F.lit(0.0)), 2) for c in "xyz")
        return spatial.candidates(points, leaves, reach).filter(far <= reach * reach).select("pid", F.col("handle").alias("node"))

    def search(self, points: DataFrame) -> DataFrame:
        """``(pid, handle)``: members whose own boxes hold the points, through the leaves."""
        met = self.near(points, 0.0).join(points, "pid").join(self.members, "node").join(self.boxes, "handle")
        inside = [F.col(c).between(F.col(f"{c}0"), F.col(f"{c}1")) for c in "xyz"]
        return met.filter(inside[0] & inside[1] & inside[2]).select("pid", "handle").distinct()

    def neighbours(self) -> DataFrame:
        """``(node, other, axis)``: leaves of a plane tree that share part of a face, and across which axis."""
        leaves = store(self.nodes.sparkSession, self.leaves().select(F.col("node").alias("handle"), *_BOX))
        size = leaves.agg(F.max(F.col("x1") - F.col("x0")).alias("s")).first()["s"] or 1.0
        pairs = spatial.box_overlap_pairs(leaves, leaves, 1e-9 * size).filter("a != b")
        one, two = (leaves.select(F.col("handle").alias(n), *(F.col(c).alias(f"{n}{c}") for c in _BOX)) for n in "ab")
        met = pairs.join(one, "a").join(two, "b")
        width = {c: F.least(f"a{c}1", f"b{c}1") - F.greatest(f"a{c}0", f"b{c}0") for c in "xyz"}
        flat = {c: F.abs(width[c]) <= 1e-9 * size for c in "xyz"}
        wide = {c: width[c] > 1e-9 * size for c in "xyz"}
        axis = F.when(flat["x"] & wide["y"] & wide["z"], "x").when(flat["y"] & wide["x"] & wide["z"], "y").when(flat["z"] & wide["x"] & wide["y"], "z")
        return met.select(F.col("a").alias("node"), F.col("b").alias("other"), axis.alias("axis")).filter("axis IS NOT NULL")

    def merged(self, node: int) -> Tree:
        """The tree with a node made a leaf: it has its leaves' members, each once."""
        n, below = F.col("node"), F.lit(False)
        k = n
        for _ in range(62):
            k = F.floor(k / 2)
            below = below | (k == node)
        own = self.members.filter(below | (n == node)).select("handle").distinct()
        count = own.count()
        nodes = self.nodes.filter(~below).withColumn("leaf", F.col("leaf") | (n == node)).withColumn("n", F.when(n == node, count).otherwise(F.col("n")))
        return replace(self, nodes=nodes, members=self.members.filter(~below & (n != node)).unionByName(own.select(F.lit(node).cast("long").alias("node"), "handle")))


def _root(boxes: DataFrame) -> DataFrame:
    bounds = [F.min(f"{c}0").alias(f"{c}0") for c in "xyz"] + [F.max(f"{c}1").alias(f"{c}1") for c in "xyz"]
    return boxes.agg(*bounds, F.count("*").alias("n")).select(F.lit(1).cast("long").alias("node"), F.lit(0).alias("depth"), *_BOX, "n")


def plane_tree(boxes: DataFrame, most: int = 6, depth: int = 30, plane: str = "middle") -> Tree:
    """Split boxes ``(handle, x0 .. z1)`` by planes across the longest side of each node, at its ``middle`` or the members' ``median``.

    Members that straddle a plane go to both sides. A node with at most ``most``
    members, or that a plane would not make smaller, is a leaf.
    """
    spark = boxes.sparkSession
    boxes = store(spark, boxes.select("handle", *_BOX))
    nodes = store(spark, _root(boxes))
    held = boxes.withColumn("node", F.lit(1).cast("long"))
    done_nodes, done_members = None, None
    for level in range(depth + 1):
        size = {c: F.col(f"n{c}1") - F.col(f"n{c}0") for c in "xyz"}
        axis = F.when((size["x"] >= size["y"]) & (size["x"] >= size["z"]), "x").when(size["y"] >= size["z"], "y").otherwise("z")
        pick = lambda name: F.when(F.col("axis") == "x", F.col(name.format("x"))).when(F.col("axis") == "y", F.col(name.format("y"))).otherwise(F.col(name.format("z")))
        named = nodes.select("node", F.col("n").alias("n_node"), *(F.col(c).alias(f"n{c}") for c in _BOX)).withColumn("axis", axis)
        named = named.withColumn("at", (pick("n{}0") + pick("n{}1")) / 2)
        low, high = pick("{}0"), pick("{}1")
        if plane == "median":
            middle = held.join(named, "node").groupBy("node").agg(F.percentile_approx((low + high) / 2, 0.5).alias("at"))
            named = named.drop("at").join(middle, "node", "left")
        # a row for each node, stored: its size is known, so that the members need not be shuffled to it
        named = store(spark, named.select("node", "axis", "at"))
        met = held.join(named, "node")
        left, right = low < F.col("at"), high > F.col("at")
        flat = (low == F.col("at")) & (high == F.col("at"))
        met = store(spark, met.select("handle", *_BOX, "node", (left | flat).alias("_left"), right.alias("_right")))
        sides = met.groupBy("node").agg(F.sum(F.col("_left").cast("long")).alias("nl"), F.sum(F.col("_right").cast("long")).alias("nr")).join(named, "node")
        split = (F.col("n") > most) & F.lit(level < depth) & (F.greatest("nl", "nr") < F.col("n"))
        whole = store(spark, nodes.join(sides, "node", "left").withColumn("leaf", ~F.coalesce(split, F.lit(False))))
        part = whole.select("node", "depth", *_BOX, "n", "leaf")
        done_nodes = part if done_nodes is None else done_nodes.unionByName(part)
        own = met.join(whole.filter("leaf").select("node"), "node", "left_semi").select("node", "handle")
        done_members = own if done_members is None else done_members.unionByName(own)
        going = whole.filter("NOT leaf")
        if going.isEmpty():
            break
        kids = None
        for k, side, count in ((0, "_left", "nl"), (1, "_right", "nr")):
            end = 1 - k
            bound = [F.when(F.col("axis") == c, F.col("at")).otherwise(F.col(f"{c}{end}")).alias(f"{c}{end}") for c in "xyz"]
            child = going.select((F.col("node") * 2 + k).alias("node"), (F.col("depth") + 1).alias("depth"), *(f"{c}{k}" for c in "xyz"), *bound, F.col(count).alias("n"))
            child = child.select("node", "depth", *_BOX, "n")
            kids = child if kids is None else kids.unionByName(child)
        nodes = store(spark, kids)
        inner = met.join(going.select("node"), "node", "left_semi")
        sides_of = F.filter(F.array(F.when(F.col("_left"), F.col("node") * 2), F.when(F.col("_right"), F.col("node") * 2 + 1)), lambda x: x.isNotNull())
        held = inner.select("handle", *_BOX, F.explode(sides_of).alias("node"))  # of the stored members, not stored again
    return Tree(store(spark, done_nodes), store(spark, done_members), boxes)


def volume_tree(boxes: DataFrame, most: int = 6, depth: int = 30) -> Tree:
    """Split boxes by the rank of their middles along the widest direction of each node's middles, in halves; nodes bound their members."""
    spark = boxes.sparkSession
    boxes = store(spark, boxes.select("handle", *_BOX))
    held = store(spark, boxes.withColumn("node", F.lit(1).cast("long")))
    done_nodes, done_members = None, None
    for level in range(depth + 1):
        bounds = [F.min(f"{c}0").alias(f"{c}0") for c in "xyz"] + [F.max(f"{c}1").alias(f"{c}1") for c in "xyz"]
        middle = {c: F.col(f"{c}0") + F.col(f"{c}1") for c in "xyz"}
        spread = [(F.max(m) - F.min(m)).alias(f"w{c}") for c, m in middle.items()]
        stats = held.groupBy("node").agg(*bounds, *spread, F.count("*").alias("n")).withColumn("depth", F.lit(level)).withColumn("leaf", (F.col("n") <= most) | F.lit(level >= depth))
        stats = store(spark, stats)
        part = stats.select("node", "depth", *_BOX, "n", "leaf")
        done_nodes = part if done_nodes is None else done_nodes.unionByName(part)
        own = held.join(stats.filter("leaf").select("node"), "node", "left_semi").select("node", "handle")
        done_members = own if done_members is None else done_members.unionByName(own)
        going = stats.filter("NOT leaf")
        if going.isEmpty():
            break
        axis = F.when((F.col("wx") >= F.col("wy")) & (F.col("wx") >= F.col("wz")), "x").when(F.col("wy") >= F.col("wz"), "y").otherwise("z")
        met = held.join(going.select("node", F.col("n").alias("_n"), axis.alias("_axis")), "node")
        key = F.when(F.col("_axis") == "x", middle["x"]).when(F.col("_axis") == "y", middle["y"]).otherwise(middle["z"])
        placed = ranked(met.withColumn("_key", key), ["node", "_key", "handle"], "_r")
        first = placed.groupBy("node").agg(F.min("_r").alias("_first"))
        right = ((F.col("_r") - F.col("_first")) * 2 >= F.col("_n")).cast("long")
        held = store(spark, placed.join(first, "node").select("handle", *_BOX, (F.col("node") * 2 + right).alias("node")))
    return Tree(store(spark, done_nodes), store(spark, done_members), boxes)


@dataclass(frozen=True)
class SpaceTree:
    """Space split by any planes: ``planes[node] = (a, b, c, d)``; points with ``ax + by + cz + d < 0`` lie below, in child 2n."""

    planes: dict[int, tuple[float, float, float, float]]

    def split(self, leaf: int, plane: tuple[float, float, float, float]) -> SpaceTree:
        if leaf in self.planes or leaf > 1 and leaf // 2 not in self.planes:
            raise ValueError(f"{leaf} is no leaf")
        return SpaceTree(self.planes | {leaf: plane})

    def merge(self, node: int) -> SpaceTree:
        """A node made a leaf; all planes below it go."""
        below = {k for k in self.planes if any(k >> s == node for s in range(k.bit_length()))}
        return SpaceTree({k: p for k, p in self.planes.items() if k not in below})

    def leaves(self) -> list[int]:
        out, left = [], [1]
        while left:
            n = left.pop()
            if n in self.planes:
                left += [2 * n + 1, 2 * n]
            else:
                out.append(n)
        return out

    def leaf_of(self, x: Column, y: Column, z: Column) -> Column:
        """The leaf that a point lies in."""

        def down(n: int) -> Column:
            if n not in self.planes:
                return F.lit(n).cast("long")
            a, b, c, d = self.planes[n]
            return F.when(a * x + b * y + c * z + d < 0, down(2 * n)).otherwise(down(2 * n + 1))

        return down(1)

    def cuts(self, o: tuple[Column, Column, Column], direction: tuple[Column, Column, Column]) -> Column:
        """Sorted distances along a ray at which it crosses planes of the tree into another leaf."""
        found = []
        for n, (a, b, c, d) in sorted(self.planes.items()):
            slope = a * direction[0] + b * direction[1] + c * direction[2]
            t = -(a * o[0] + b * o[1] + c * o[2] + d) / slope
            at = lambda s, t=t: self.leaf_of(*(p + (t + s) * q for p, q in zip(o, direction)))
            found.append(F.when((slope != 0) & (t > 0) & (at(1e-9) != at(-1e-9)), t))
        return F.array_sort(F.array_distinct(F.filter(F.array(*found), lambda t: t.isNotNull())))


def oriented_tree(points: DataFrame, depth: int) -> DataFrame:
    """``(handle, node)``: members ``(handle, x, y, z)`` of oriented boxes, each split at the mean along its longest axis, ``depth`` times.

    Boxes of any level follow by ``topology.oriented_boxes`` over its nodes.
    """
    from .topology import principal_axes

    spark = points.sparkSession
    held = points.select("handle", *"xyz", F.lit(1).cast("long").alias("group"))
    for _ in range(depth):
        axes = principal_axes(held)
        met = held.join(axes.select("group", *(F.col(f"m{c}").alias(f"m{c}") for c in "xyz"), "a0x", "a0y", "a0z"), "group")
        side = sum((F.col(c) - F.col(f"m{c}")) * F.col(f"a0{c}") for c in "xyz")
        held = store(spark, met.select("handle", *"xyz", (F.col("group") * 2 + (side >= 0).cast("long")).alias("group")))
    return held.select("handle", F.col("group").alias("node"))
