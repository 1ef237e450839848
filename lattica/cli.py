"""Command-line tools over mesh files: ``python -m lattica.cli COMMAND ...``.

Each command is a function of a session and its arguments that returns a table to
print, or None where it only writes. Files are read and written by their suffix;
a path without one is a folder of the native store.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import model
from .functions import quality
from .model import Mesh, MeshError, Tag
from .operators import distribution, measures, mutation, skinning, tags
from .sources import files, store, text_formats  # noqa: F401  text_formats adds its readers

Command = Callable[[SparkSession, argparse.Namespace], DataFrame | None]
WRITERS = {"vtk": files.save_vtk, "msh": files.save_gmsh, "stl": files.save_stl, "smf": files.save_smf, "gmv": files.save_gmv, "ans": files.save_ansys}
COMMANDS: dict[str, tuple[Command, Callable[[argparse.ArgumentParser], None]]] = {}


def command(*arguments: tuple):
    """Register a command with its arguments, each a name (or names) and options."""

    def add(parser: argparse.ArgumentParser) -> None:
        for *names, options in arguments:
            parser.add_argument(*names, **options)

    def register(run: Command) -> Command:
        COMMANDS[run.__name__.replace("_", "-")] = run, add
        return run

    return register


_IN, _OUT = ("input", {}), ("output", {})


def read(spark: SparkSession, path: str, options: str = "") -> Mesh:
    suffix = path.rsplit("/", 1)[-1].rpartition(".")[2].lower()
    if suffix == "node":
        return files.load_tetgen(spark, path)
    return files.load(spark, path, options=options) if suffix in files.PARSERS else store.load(spark, path)


def write(mesh: Mesh, path: str, names: tuple[str, ...] = ()) -> None:
    suffix = path.rsplit("/", 1)[-1].rpartition(".")[2].lower()
    if suffix == "vtk":
        files.save_vtk(mesh, path, names)
    elif suffix in WRITERS:
        WRITERS[suffix](mesh, path)
    elif "." in path.rsplit("/", 1)[-1]:
        raise MeshError("NOT_IMPLEMENTED", f"no writer for {suffix}")
    else:
        store.save(mesh, path)


def top_dimension(mesh: Mesh) -> int:
    return mesh.elements.agg(F.max(model.dimension_of(F.col("handle")))).first()[0] or 0


def _with_tag(mesh: Mesh, name: str, values: DataFrame) -> Mesh:
    return mesh.with_(tags=mesh.tags | {name: Tag(name, "double", values)})


@command(_IN, _OUT, ("--options", {"default": "", "help": "option string of the reader"}), ("--dimension", {"type": int, "help": "keep elements of this dimension only"}), ("--set", {"help": "keep the elements of the set of this name"}), ("--tag", {"action": "append", "default": [], "help": "write this tag, too"}))
def convert(spark: SparkSession, a: argparse.Namespace) -> None:
    """Read a file and write it in another format, whole or in part."""
    mesh = read(spark, a.input, a.options)
    if a.dimension is not None:
        mesh = mesh.with_(elements=mesh.elements.filter(model.of_dimension(F.col("handle"), a.dimension)))
    if a.set is not None:
        named = mesh.tag("NAME").values.filter(F.col("value") == a.set).select(F.col("entity").alias("set"))
        mesh = mesh.with_(elements=mesh.elements.join(mesh.members.join(named, "set", "left_semi").select(F.col("entity").alias("handle")), "handle", "left_semi"))
    write(mesh, a.output, tuple(a.tag))


@command(_IN)
def size(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Number, total, least, mean and largest size of the elements of each type."""
    mesh = read(spark, a.input)
    found = None
    for dim in (1, 2, 3):
        part = measures.size_statistics(mesh, dim)
        found = part if found is None else found.unionByName(part)
    return found.select(model.type_name(F.col("etype")).alias("type"), "n", "total", "minimum", "average", "rms", "maximum", "deviation").orderBy("type")


@command(_IN, _OUT, ("--dimension", {"type": int, "help": "of the elements, the highest there is by default"}))
def skin(spark: SparkSession, a: argparse.Namespace) -> None:
    """Write the facets that one element only has."""
    mesh = read(spark, a.input)
    found = skinning.skin_facets(mesh, a.dimension or top_dimension(mesh)).select(F.col("sub_etype").alias("etype"), "sub_conn", "elem", "side")
    from .operators.ranges import ranked

    rows = ranked(found, ["etype", "elem", "side"], "_n")
    elements = rows.select(model.handle(F.col("etype"), F.col("_n") + 1).alias("handle"), F.col("etype").cast("int").alias("etype"), F.col("sub_conn").alias("conn"))
    used = elements.select(F.explode("conn").alias("handle")).distinct()
    write(mesh.with_(elements=elements, vertices=mesh.vertices.join(used, "handle", "left_semi"), members=None, sets=None, tags={}), a.output)


@command(_IN, ("--output", {"help": "write the mesh with tag DEPTH"}))
def depth(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Elements by their distance from the skin, in layers."""
    mesh = read(spark, a.input)
    found = skinning.depth(mesh, top_dimension(mesh))
    if a.output:
        write(_with_tag(mesh, "DEPTH", found.select(F.col("handle").alias("entity"), F.col("depth").cast("double").alias("value"))), a.output, ("DEPTH",))
    return found.groupBy("depth").agg(F.count("*").alias("n")).orderBy("depth")


@command(_IN, _OUT, ("tag", {}), ("--vertices", {"action": "store_true"}))
def propagate(spark: SparkSession, a: argparse.Namespace) -> None:
    """Give sets' values of a tag to their members (or the members' vertices) and write the mesh."""
    mesh = read(spark, a.input)
    values = tags.propagate(mesh, a.tag, a.vertices).select("entity", F.col("value").cast("double").alias("value"))
    write(_with_tag(mesh, a.tag, values), a.output, (a.tag,))


@command(_IN)
def sets(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Sets with their names and numbers of members by type."""
    mesh = read(spark, a.input)
    named = mesh.tag("NAME").values.select(F.col("entity").alias("set"), F.col("value").alias("name"))
    return mesh.members.join(named, "set").groupBy("name", model.type_name(model.etype_of(F.col("entity"))).alias("type")).agg(F.count("*").alias("n")).orderBy("name", "type")


@command(_IN, ("--metric", {"action": "append", "default": []}))
def check_quality(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Number, least and largest value of quality metrics, by type."""
    mesh = read(spark, a.input)
    found = None
    for row in mesh.elements.select("etype").distinct().orderBy("etype").collect():  # at most a dozen types
        etype = row["etype"]
        own = [m for m in (a.metric or quality.available(etype)) if m in quality.available(etype) and not m.endswith("size")]
        if own:
            part = measures.quality_statistics(mesh, etype, own).withColumn("type", F.lit(model.ETYPES[etype]))
            found = part if found is None else found.unionByName(part)
    if found is None:
        raise MeshError("ENTITY_NOT_FOUND", "no element has any of the metrics")
    return found.select("type", "metric", "n", "low", "high").orderBy("type", "metric")


@command(_IN, _OUT, ("--tolerance", {"type": float, "default": 1e-6}), ("--skin", {"action": "store_true", "help": "merge vertices of the skin only"}))
def merge(spark: SparkSession, a: argparse.Namespace) -> None:
    """Merge vertices that lie within a tolerance, and write the mesh."""
    mesh = read(spark, a.input)
    write(mutation.merge_vertices(mesh, a.tolerance, top_dimension(mesh) if a.skin else None), a.output)


@command(_IN, _OUT, ("parts", {"type": int}), ("--method", {"choices": ["curve", "bisect", "share"], "default": "curve"}))
def partition(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Deal the elements into parts, by their centroids or in order, and write the mesh with tag PARTITION."""
    mesh = read(spark, a.input)
    dim = top_dimension(mesh)
    centers = measures.centroids(mesh, dim)
    if a.method == "share":
        from .operators.fields import spread

        found = spread(centers.select("handle"), a.parts)
    elif a.method == "bisect":
        found = distribution.bisect(centers, (a.parts - 1).bit_length())
    else:
        width = centers.agg(F.greatest(*(F.max(c) - F.min(c) for c in "xyz")).alias("w")).first()["w"]
        found = distribution.curve_partition(centers, a.parts, max((width or 1.0) / 60_000, 1e-300))
    write(_with_tag(mesh, "PARTITION", found.select(F.col("handle").alias("entity"), F.col("part").cast("double").alias("value"))), a.output, ("PARTITION",))
    return found.groupBy("part").agg(F.count("*").alias("n")).orderBy("part")


@command(("master", {}), ("slave", {}), _OUT)
def transfer_parts(spark: SparkSession, a: argparse.Namespace) -> None:
    """Give each element of a second mesh the part of the first mesh's element that is nearest to its centroid."""
    one, two = read(spark, a.master), read(spark, a.slave)
    points = lambda m: measures.centroids(m, top_dimension(m))
    from .operators.spatial import closest_triangle

    p = F.struct("x", "y", "z")
    flat = points(one).select("handle", p.alias("a"), p.alias("b"), p.alias("c"))
    near = closest_triangle(points(two).withColumnRenamed("handle", "pid"), flat)
    values = near.join(one.tag("PARTITION").values.withColumnRenamed("entity", "handle"), "handle").select(F.col("pid").alias("entity"), "value")
    write(_with_tag(two, "PARTITION", values), a.output, ("PARTITION",))


@command(_IN, _OUT)
def second_order(spark: SparkSession, a: argparse.Namespace) -> None:
    """Write the mesh with a node in the middle of each edge."""
    mesh = read(spark, a.input)
    write(mutation.add_mid_edge_nodes(mesh, top_dimension(mesh)), a.output)


@command(_IN, _OUT, ("--degree", {"type": int, "default": 2}), ("--levels", {"type": int, "default": 1}))
def refine(spark: SparkSession, a: argparse.Namespace) -> None:
    """Refine all elements of the mesh's one type, once or more often."""
    mesh = read(spark, a.input)
    kinds = [r["etype"] for r in mesh.elements.filter(model.of_dimension(F.col("handle"), top_dimension(mesh))).select("etype").distinct().collect()]
    if len(kinds) != 1:
        raise MeshError("NOT_IMPLEMENTED", "more than one type of elements")
    write(mutation.hierarchy(mesh, kinds[0], [a.degree] * a.levels)[-1].with_(members=None, sets=None, tags={}), a.output)


@command(_IN, ("other", {}), ("--tolerance", {"type": float, "default": 1e-9}))
def compare(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Differences of two meshes by handle: vertices, elements and the values of tags that both have."""
    one, two = read(spark, a.input), read(spark, a.other)
    far = [F.abs(F.col(f"p.{c}") - F.col(f"q.{c}")) > a.tolerance for c in "xyz"]
    at = lambda m, n: m.vertices.select("handle", F.struct("x", "y", "z").alias(n))
    rows = at(one, "p").join(at(two, "q"), "handle", "full").filter(F.col("p").isNull() | F.col("q").isNull() | far[0] | far[1] | far[2]).select(F.lit("vertices").alias("what"))
    conn = one.elements.select("handle", "conn").join(two.elements.select("handle", F.col("conn").alias("other")), "handle", "full")
    rows = rows.unionByName(conn.filter(~F.col("conn").eqNullSafe(F.col("other"))).select(F.lit("elements").alias("what")))
    for name in sorted(one.tags.keys() & two.tags.keys()):
        v, w = one.tags[name].values, two.tags[name].values.withColumnRenamed("value", "other")
        same = F.col("value").eqNullSafe(F.col("other"))
        if one.tags[name].dtype == "double":
            same = same | (F.abs(F.col("value") - F.col("other")) <= a.tolerance)
        rows = rows.unionByName(v.join(w, "entity", "full").filter(~F.coalesce(same, F.lit(False))).select(F.lit(f"tag {name}").alias("what")))
    return rows.groupBy("what").agg(F.count("*").alias("differences")).orderBy("what")


@command(("source", {}), ("target", {}), ("--output", {"help": "write the weights as Parquet"}))
def remap(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Overlap two surface meshes in the plane (or on the unit sphere), and say what the map between them keeps."""
    from .operators import remap as kernel

    one, two = read(spark, a.source), read(spark, a.target)
    flat = one.vertices.filter("abs(z) > 1e-12").isEmpty()
    overlap = (kernel.overlap_in_plane if flat else kernel.overlap_on_sphere)(one, two)
    from .operators.fixpoint import store as keep

    overlap = keep(spark, overlap)
    w = kernel.weights(overlap)
    if a.output:
        w.write.mode("overwrite").parquet(a.output)
    return overlap.agg(F.count("*").alias("pieces"), F.sum("area").alias("area"), F.countDistinct("source").alias("sources"), F.countDistinct("target").alias("targets"))


def run(spark: SparkSession, argv: list[str]) -> DataFrame | None:
    """One command; raises ``SystemExit`` for wrong arguments."""
    parser = argparse.ArgumentParser(prog="lattica", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, (what, add) in COMMANDS.items():
        add(commands.add_parser(name, help=(what.__doc__ or "").split("\n")[0]))
    a = parser.parse_args(argv)
    return COMMANDS[a.command][0](spark, a)


def main(argv: list[str] | None = None) -> int:
    spark = SparkSession.builder.appName("lattica").getOrCreate()
    try:
        out = run(spark, sys.argv[1:] if argv is None else argv)
    except MeshError as e:
        print(e, file=sys.stderr)
        return 1
    if out is not None:
        for row in [out.columns, *out.toLocalIterator()]:
            print("\t".join(map(str, row)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
