"""Mesh files as sources and sinks.

A reader parses each file in one task (files are read in parallel) into rows of
one relation, from which vertices, elements, sets and tags are lazy selections.
Handles of the n-th file (by path) are shifted by ``n << 36``. Writers make the
lines on the executors, in ranges of handles, and one task joins the pieces.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import model
from ..model import EDGE, HEX, POLYGON, PRISM, PYRAMID, QUAD, TET, TRI, VERTEX, Mesh, MeshError, Tag
from .options import Options

FILE_SHIFT = 36


@dataclass
class Parsed:
    """Coordinates, cells ``(etype, 0-based vertices)``, values ``(name, on points, index, value)`` and sets by name."""

    points: list[tuple[float, float, float]] = field(default_factory=list)
    cells: list[tuple[int, list[int]]] = field(default_factory=list)
    values: list[tuple[str, bool, int, float]] = field(default_factory=list)
    sets: dict[str, list[int]] = field(default_factory=dict)
    point_sets: dict[str, list[int]] = field(default_factory=dict)


# VTK cell types, their entity types and, where it differs, their vertex order.
VTK_TYPES = {1: VERTEX, 3: EDGE, 5: TRI, 7: POLYGON, 8: QUAD, 9: QUAD, 10: TET, 11: HEX, 12: HEX, 13: PRISM, 14: PYRAMID, 21: EDGE, 22: TRI, 23: QUAD, 24: TET, 25: HEX, 26: PRISM, 27: PYRAMID, 28: QUAD, 29: HEX}
VTK_ORDER = {8: (0, 1, 3, 2), 11: (0, 1, 3, 2, 4, 5, 7, 6), 13: (0, 2, 1, 3, 5, 4)}
VTK_OF = {EDGE: 3, TRI: 5, POLYGON: 7, QUAD: 9, TET: 10, HEX: 12, PRISM: 13, PYRAMID: 14}
# Gmsh element types.
GMSH_TYPES = {1: EDGE, 2: TRI, 3: QUAD, 4: TET, 5: HEX, 6: PRISM, 7: PYRAMID, 8: EDGE, 9: TRI, 10: QUAD, 11: TET, 12: HEX, 15: VERTEX, 16: QUAD, 17: HEX, 18: PRISM, 19: PYRAMID}
GMSH_OF = {EDGE: 1, TRI: 2, QUAD: 3, TET: 4, HEX: 5, PRISM: 6, PYRAMID: 7}
# NASTRAN cards of elements.
NASTRAN_CARDS = {"CBAR": EDGE, "CROD": EDGE, "CTRIA3": TRI, "CQUAD4": QUAD, "CTETRA": TET, "CPENTA": PRISM, "CHEXA": HEX}


def parse_vtk(data: bytes) -> Parsed:
    """VTK legacy ASCII: unstructured grids, structured points and grids, rectilinear grids, polydata; scalars, vectors and fields."""
    lines = data.decode("utf-8", "replace").split("\n")
    if len(lines) < 4 or not lines[0].startswith("# vtk DataFile"):
        raise MeshError("FAILURE", "not a VTK file")
    if lines[2].strip().upper() != "ASCII":
        raise MeshError("NOT_IMPLEMENTED", "binary VTK")
    words = " ".join(lines[3:]).split()
    out, at, n_points = Parsed(), 0, 0
    dims: list[int] = []
    axes: dict[str, list[float]] = {}
    origin, spacing = [0.0] * 3, [1.0] * 3
    kind, raw, types, on_points, count = "", [], [], True, 0

    def take(n: int) -> list[str]:
        nonlocal at
        got = words[at : at + n]
        if len(got) < n:
            raise MeshError("FAILURE", "file ends early")
        at += n
        return got

    def polygons(n: int, name: str) -> None:
        for _ in range(n):
            k = int(take(1)[0])
            conn = list(map(int, take(k)))
            if name == "LINES":
                out.cells.extend((EDGE, list(p)) for p in zip(conn, conn[1:]))
            elif name == "TRIANGLE_STRIPS":
                out.cells.extend((TRI, [conn[i + i % 2], conn[i + 1 - i % 2], conn[i + 2]]) for i in range(k - 2))
            elif name != "VERTICES":
                out.cells.append(({3: TRI, 4: QUAD}.get(k, POLYGON), conn))

    while at < len(words):
        word = take(1)[0].upper()
        if word == "DATASET":
            kind = take(1)[0].upper()
        elif word == "DIMENSIONS":
            dims = list(map(int, take(3)))
        elif word == "ORIGIN":
            origin = list(map(float, take(3)))
        elif word in ("SPACING", "ASPECT_RATIO"):
            spacing = list(map(float, take(3)))
        elif word in ("X_COORDINATES", "Y_COORDINATES", "Z_COORDINATES"):
            n = int(take(2)[0])
            axes[word[0]] = list(map(float, take(n)))
        elif word == "POINTS":
            n_points = int(take(2)[0])
            flat = list(map(float, take(3 * n_points)))
            out.points = list(zip(flat[::3], flat[1::3], flat[2::3]))
        elif word == "CELLS":
            n = int(take(2)[0])
            for _ in range(n):
                raw.append(list(map(int, take(int(take(1)[0])))))
        elif word == "CELL_TYPES":
            types = list(map(int, take(int(take(1)[0]))))
        elif word in ("VERTICES", "LINES", "POLYGONS", "TRIANGLE_STRIPS"):
            polygons(int(take(2)[0]), word)
        elif word in ("POINT_DATA", "CELL_DATA"):
            on_points, count = word == "POINT_DATA", int(take(1)[0])
        elif word == "SCALARS":
            name = take(2)[0]
            if at < len(words) and words[at].isdigit() and words[at] in "1234":
                take(1)
            if at < len(words) and words[at].upper() == "LOOKUP_TABLE":
                take(2)
            out.values += [(name, on_points, i, float(v)) for i, v in enumerate(take(count))]
        elif word in ("VECTORS", "NORMALS"):
            name = take(2)[0]
            out.values += [(f"{name}_{i % 3}", on_points, i // 3, float(v)) for i, v in enumerate(take(3 * count))]
        elif word == "TENSORS":
            name = take(2)[0]
            out.values += [(f"{name}_{i % 9}", on_points, i // 9, float(v)) for i, v in enumerate(take(9 * count))]
        elif word == "LOOKUP_TABLE":
            take(4 * int(take(2)[1]))
        elif word == "FIELD":
            for _ in range(int(take(2)[1])):
                name, width, n, _type = take(4)
                flat = take(int(width) * int(n))
                w = int(width)
                out.values += [(name if w == 1 else f"{name}_{i % w}", on_points, i // w, float(v)) for i, v in enumerate(flat)]
    for t, conn in zip(types, raw):
        if t not in VTK_TYPES:
            raise MeshError("NOT_IMPLEMENTED", f"VTK cell type {t}")
        order = VTK_ORDER.get(t)
        out.cells.append((VTK_TYPES[t], [conn[i] for i in order] + conn[len(order) :] if order else conn))
    if kind in ("STRUCTURED_POINTS", "STRUCTURED_GRID", "RECTILINEAR_GRID"):
        nx, ny, nz = dims
        if kind == "STRUCTURED_POINTS":
            axes = {c: [o + s * i for i in range(n)] for c, o, s, n in zip("XYZ", origin, spacing, dims)}
        if axes:
            out.points = [(x, y, z) for z in axes["Z"] for y in axes["Y"] for x in axes["X"]]
        at_ = lambda i, j, k: i + nx * (j + ny * k)
        ring = ((0, 0), (1, 0), (1, 1), (0, 1))
        for k in range(max(1, nz - 1)):
            for j in range(ny - 1):
                for i in range(nx - 1):
                    conn = [at_(i + a, j + b, k) for a, b in ring]
                    out.cells.append((QUAD, conn) if nz == 1 else (HEX, conn + [at_(i + a, j + b, k + 1) for a, b in ring]))
    return out


def _merged(corners: np.ndarray) -> tuple[list[tuple[float, float, float]], np.ndarray]:
    """Vertices with equal coordinates made one, in coordinate order."""
    points, which = np.unique(corners.reshape(-1, 3) + 0.0, axis=0, return_inverse=True)
    return list(map(tuple, points.tolist())), which.reshape(-1, 3)


def parse_stl(data: bytes) -> Parsed:
    """STL, ASCII or binary (little or big endian)."""
    flat: np.ndarray
    if data[:5].lower() == b"solid" and b"facet" in data[:4096]:
        words = data.split()
        at = [i for i, w in enumerate(words) if w.lower() == b"vertex"]
        flat = np.array([[float(x) for x in words[i + 1 : i + 4]] for i in at]).reshape(-1, 3)
    else:
        for order in "<>":
            n = struct.unpack_from(order + "I", data, 80)[0] if len(data) >= 84 else 0
            if 84 + 50 * n == len(data):
                kind = np.dtype([("n", order + "f4", 3), ("v", order + "f4", (3, 3)), ("a", order + "u2")])
                flat = np.frombuffer(data, kind, n, 84)["v"].astype(float).reshape(-1, 3)
                break
        else:
            raise MeshError("FAILURE", "not an STL file")
    points, tris = _merged(flat) if len(flat) else ([], np.empty((0, 3), int))
    return Parsed(points, [(TRI, t) for t in tris.tolist()])


def parse_obj(data: bytes) -> Parsed:
    """OBJ: vertices, faces and objects or groups (as sets)."""
    out, group = Parsed(), None
    for line in data.decode("utf-8", "replace").splitlines():
        w = line.split()
        if not w:
            continue
        if w[0] == "v":
            out.points.append(tuple(map(float, w[1:4])))
        elif w[0] in ("o", "g"):
            group = w[1] if len(w) > 1 else "default"
            out.sets.setdefault(group, [])
        elif w[0] == "f":
            conn = [int(x.split("/")[0]) for x in w[1:]]
            conn = [i - 1 if i > 0 else len(out.points) + i for i in conn]
            faces = [(TRI, conn)] if len(conn) == 3 else [(TRI, conn[:3]), (TRI, [conn[0], conn[2], conn[3]])] if len(conn) == 4 else [(POLYGON, conn)]
            for f in faces:
                if group is not None:
                    out.sets[group].append(len(out.cells))
                out.cells.append(f)
    return out


def parse_gmsh(data: bytes) -> Parsed:
    """Gmsh 1 and 2 ASCII: nodes, elements and their physical groups (as sets)."""
    lines = iter(data.decode("utf-8", "replace").split("\n"))
    out, ids = Parsed(), {}
    for line in lines:
        word = line.strip()
        if word in ("$Nodes", "$NOD"):
            for _ in range(int(next(lines))):
                w = next(lines).split()
                ids[int(w[0])] = len(out.points)
                out.points.append(tuple(map(float, w[1:4])))
        elif word in ("$Elements", "$ELM"):
            for _ in range(int(next(lines))):
                w = list(map(int, next(lines).split()))
                t = GMSH_TYPES.get(w[1])
                if t is None:
                    raise MeshError("NOT_IMPLEMENTED", f"Gmsh element type {w[1]}")
                tags = w[3 : 3 + w[2]] if word == "$Elements" else w[2:4]
                conn = [ids[i] for i in (w[3 + w[2] :] if word == "$Elements" else w[5:])]
                if t == VERTEX:
                    continue
                if tags:
                    out.sets.setdefault(f"material:{tags[0]}", []).append(len(out.cells))
                out.cells.append((t, conn))
    return out


def parse_smf(data: bytes) -> Parsed:
    """QSlim SMF: vertices and faces, with translations and scales that nest by begin and end."""
    out = Parsed()
    stack = [(np.eye(4), 0)]
    for line in data.decode("utf-8", "replace").splitlines():
        w = line.split()
        if not w or w[0].startswith("#"):
            continue
        now, base = stack[-1]
        if w[0] == "begin":
            stack.append((now.copy(), len(out.points)))
        elif w[0] == "end" and len(stack) > 1:
            stack.pop()
        elif w[0] in ("trans", "scale"):
            m = np.eye(4)
            v = list(map(float, w[1:4]))
            if w[0] == "trans":
                m[:3, 3] = v
            else:
                m[0, 0], m[1, 1], m[2, 2] = v
            stack[-1] = (now @ m, base)
        elif w[0] == "rot":
            a, k = np.radians(float(w[2])), "xyz".index(w[1])
            i, j = [x for x in range(3) if x != k]
            if k == 1:
                i, j = j, i
            m = np.eye(4)
            m[i, i] = m[j, j] = np.cos(a)
            m[j, i], m[i, j] = np.sin(a), -np.sin(a)
            stack[-1] = (now @ m, base)
        elif w[0] == "v":
            p = now @ np.array([*map(float, w[1:4]), 1.0])
            out.points.append(tuple(p[:3].tolist()))
        elif w[0] in ("f", "t"):
            conn = [base + int(x) - 1 for x in w[1:]]
            out.cells.append(({3: TRI, 4: QUAD}.get(len(conn), POLYGON), conn))
    return out


def _numbers(data: bytes) -> list[list[float]]:
    return [[float(x) for x in line.split("#")[0].split()] for line in data.decode("utf-8", "replace").splitlines() if line.split("#")[0].strip()]


def parse_tetgen(node: bytes, ele: bytes | None = None, face: bytes | None = None) -> Parsed:
    """TetGen: a node file and, if given, its element and face files."""
    out = Parsed()
    rows = _numbers(node)
    n, _, n_attr, _ = (int(x) for x in (rows[0] + [0, 0, 0])[:4])
    ids = {}
    for r in rows[1 : n + 1]:
        ids[int(r[0])] = len(out.points)
        for k in range(n_attr):
            out.values.append((f"attribute_{k}", True, len(out.points), r[4 + k]))
        out.points.append((r[1], r[2], r[3]))
    for data, etype, size in ((ele, TET, None), (face, TRI, 3)):
        if data is None:
            continue
        rows = _numbers(data)
        m = int(rows[0][0])
        k = size or int(rows[0][1])
        out.cells += [(etype, [ids[int(x)] for x in r[1 : 1 + k]]) for r in rows[1 : m + 1]]
    return out


def parse_nastran(data: bytes) -> Parsed:
    """NASTRAN bulk data: GRID and element cards in small fixed, large fixed and free fields."""
    out, ids, cards = Parsed(), {}, []
    for line in data.decode("utf-8", "replace").splitlines():
        line = line.split("$")[0].rstrip()
        if not line:
            continue
        if "," in line:
            f = [x.strip() for x in line.split(",")]
        elif "*" in line[:8]:
            f = [line[:8].strip().rstrip("*")] + [line[i : i + 16].strip() for i in range(8, 72, 16)]
        else:
            f = [line[i : i + 8].strip() for i in range(0, min(len(line), 72), 8)]
        if (line[0] in "+*" or line[:8].strip() == "") and cards:
            cards[-1] += f[1:]
        else:
            cards.append([f[0].upper().rstrip("*")] + f[1:])

    def real(s: str) -> float:
        if not s:
            return 0.0
        body = s[1:].replace("E", "e").replace("D", "e").replace("d", "e")
        if "e" not in body:
            body = body.replace("+", "e+").replace("-", "e-")
        return float(s[0] + body)

    for c in cards:
        if c[0] == "GRID":
            ids[int(c[1])] = len(out.points)
            out.points.append(tuple(map(real, (c[3:6] + ["", "", ""])[:3])))
    for c in cards:
        t = NASTRAN_CARDS.get(c[0])
        if t is not None:
            conn = [ids[int(x)] for x in c[3 : 3 + model.CORNERS[t]]]
            out.sets.setdefault(f"material:{c[2]}", []).append(len(out.cells))
            out.cells.append((t, conn))
    return out


PARSERS: dict[str, Callable[[bytes], Parsed]] = {"vtk": parse_vtk, "stl": parse_stl, "obj": parse_obj, "msh": parse_gmsh, "smf": parse_smf, "nas": parse_nastran, "bdf": parse_nastran, "node": parse_tetgen}


def register_reader(suffix: str, parser: Callable[[bytes], Parsed]) -> None:
    """Add a format of one's own."""
    PARSERS[suffix.lower()] = parser


def _parser_of(path: str, name: str | None, parsers: dict[str, Callable[[bytes], Parsed]]) -> Callable[[bytes], Parsed]:
    suffix = (name or path.rsplit(".", 1)[-1]).lower()
    if suffix not in parsers:
        raise MeshError("NOT_IMPLEMENTED", f"no reader for {suffix}")
    return parsers[suffix]


ROWS = "path string, kind string, num long, etype int, conn array<long>, x double, y double, z double, name string"


def _table(path: str, p: Parsed) -> pa.Table:
    """Rows of a parsed file: points (v), cells (e), set members (s), values on points (p) and on cells (c)."""
    seen = [0] * 12
    ids = []
    for t, _ in p.cells:
        seen[t] += 1
        ids.append(seen[t])
    rows: list[tuple] = [("v", i + 1, 0, None, *q, None) for i, q in enumerate(p.points)]
    rows += [("e", ids[i], t, [c + 1 for c in conn], None, None, None, None) for i, (t, conn) in enumerate(p.cells)]
    rows += [("s", ids[c], p.cells[c][0], None, None, None, None, name) for name, cells in p.sets.items() for c in cells]
    rows += [("s", i + 1, VERTEX, None, None, None, None, name) for name, points in p.point_sets.items() for i in points]
    rows += [("p" if on else "c", i + 1 if on else ids[i], 0 if on else p.cells[i][0], None, v, None, None, name) for name, on, i, v in p.values]
    cols = list(zip(*rows)) if rows else [[]] * 8
    types = (pa.string(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.float64(), pa.float64(), pa.float64(), pa.string())
    arrays = [pa.array(c, t) for c, t in zip(cols, types)]
    return pa.table([pa.array([path] * len(rows), pa.string()), *arrays], ["path", "kind", "num", "etype", "conn", "x", "y", "z", "name"])


def load(spark: SparkSession, path: str, format: str | None = None, options: str = "", **more: str) -> Mesh:
    """Read one file, or all files of a folder or pattern, into a mesh.

    The reader is chosen by ``format`` or the suffix. Sets get list handles in
    order of file and name, with their names in tag NAME; values become tags named
    as in the file. ``options`` is an option string: NO_TAGS leaves out values,
    NO_SETS sets, PARALLEL=READ_PART with RANK and RANKS keeps one of equal shares
    of each dimension's elements with their vertices (BCAST, the default, keeps
    all). Options that no part of the reader asks for are an error.
    """
    asked = Options.parse(";".join([options, *(f"{n}={v}" for n, v in more.items())]))
    no_tags, no_sets = asked.flag("NO_TAGS"), asked.flag("NO_SETS")
    way = asked.choice("PARALLEL", ["NONE", "BCAST", "READ_PART"]) if "parallel" in {n.lower() for n, _ in asked.items} else 0
    share = (asked.integer("RANK"), asked.integer("RANKS")) if way == 2 else None
    asked.done()
    if format is not None:
        _parser_of("", format, PARSERS)
    parsers = dict(PARSERS)  # travels to the executors, which don't know what was registered here

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                yield from _table(p, _parser_of(p, format, parsers)(data)).to_batches(max_chunksize=50_000)

    from ..operators.fixpoint import store

    rows = store(spark, spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, ROWS))
    files = rows.select("path").distinct().withColumn("shift", F.shiftleft((F.row_number().over(Window.orderBy("path")) - 1).cast("long"), FILE_SHIFT))
    placed = rows.join(F.broadcast(files), "path") if files.count() < 10_000 else rows.join(files, "path")
    ident = F.col("num") + F.col("shift")
    vertices = placed.filter("kind = 'v'").select(ident.alias("handle"), "x", "y", "z")
    elements = placed.filter("kind = 'e'").select(model.handle(F.col("etype"), ident).alias("handle"), "etype", F.transform("conn", lambda c: c + F.col("shift")).alias("conn"))
    entity = model.handle(F.col("etype"), ident)
    named = placed.filter("kind = 's'").select("path", "name").distinct().select("path", "name", model.handle(model.ENTITYSET, F.row_number().over(Window.orderBy("path", "name"))).alias("set"))
    members = placed.filter("kind = 's'").join(named, ["path", "name"]).select("set", F.lit(0).cast("long").alias("pos"), entity.alias("entity"))
    names = [r["name"] for r in rows.filter("kind IN ('p', 'c')").select("name").distinct().collect()]
    tags = {n: Tag(n, "double", placed.filter((F.col("name") == n) & F.col("kind").isin("p", "c")).select(entity.alias("entity"), F.col("x").alias("value"))) for n in names}
    tags["NAME"] = Tag("NAME", "string", named.select(F.col("set").alias("entity"), F.col("name").alias("value")))
    if no_tags:
        tags = {"NAME": tags["NAME"]}
    if no_sets:
        named, members, tags = named.limit(0), members.limit(0), {n: t for n, t in tags.items() if n != "NAME"}
    mesh = Mesh(vertices, elements, named.select(F.col("set").alias("handle"), F.lit(model.SET_LIKE).alias("flags")), members, spark.createDataFrame([], "parent long, child long, pos int"), None, tags)
    return mesh if share is None else part(mesh, *share)


def part(mesh: Mesh, rank: int, ranks: int) -> Mesh:
    """What one of several readers keeps: its share of the elements, their vertices, and what sets and tags say of both."""
    from dataclasses import replace

    from .util import gathered_nodes, part_of

    own = mesh.elements.join(part_of(mesh.elements.select("handle"), rank, ranks), "handle", "left_semi")
    vertices = gathered_nodes(mesh, own.select("handle"))
    kept = own.select("handle").union(vertices.select("handle")).union(mesh.sets.select("handle")).withColumnRenamed("handle", "entity")
    tags = {n: replace(t, values=t.values.join(kept, "entity", "left_semi")) for n, t in mesh.tags.items()}
    return mesh.with_(vertices=vertices, elements=own, members=mesh.members.join(kept, "entity", "left_semi").select("set", "pos", "entity"), tags=tags)


def load_tetgen(spark: SparkSession, node: str) -> Mesh:
    """A TetGen node file with the ``.ele`` and ``.face`` files beside it."""
    store, path = fs.FileSystem.from_uri(node)

    def content(p: str) -> bytes | None:
        if store.get_file_info(p).type == fs.FileType.NotFound:
            return None
        with store.open_input_stream(p) as f:
            return f.read()

    stem = path.removesuffix(".node")
    p = parse_tetgen(content(path) or b"0", content(stem + ".ele"), content(stem + ".face"))
    t = _table(node, p).to_pandas()
    v, e = t[t.kind == "v"], t[t.kind == "e"]
    vertices = spark.createDataFrame(list(zip(v.num.tolist(), v.x.tolist(), v.y.tolist(), v.z.tolist())), "handle long, x double, y double, z double")
    elements = spark.createDataFrame([((int(a) << model.SHIFT) | int(i), int(a), [int(x) for x in c]) for i, a, c in zip(e.num, e.etype, e.conn)], "handle long, etype int, conn array<long>")
    return Mesh(vertices, elements)


# sinks ---------------------------------------------------------------------------

def _numbered(mesh: Mesh) -> tuple[DataFrame, DataFrame]:
    """Vertices with places from 0 in handle order, and elements whose connectivity has such places."""
    from ..operators.fixpoint import store
    from ..operators.ranges import index

    place = store(mesh.spark, index(mesh.vertices.select("handle")))
    vertices = mesh.vertices.join(place, "handle")
    inc = mesh.incidence().join(place.withColumnRenamed("handle", "vertex"), "vertex")
    conn = inc.groupBy(F.col("elem").alias("handle")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "index"))), lambda s: s["index"]).alias("conn"))
    return vertices, store(mesh.spark, mesh.elements.select("handle", "etype").join(conn, "handle"))


def _lines(df: DataFrame, by: str, line: Column) -> DataFrame:
    """Lines of a table in order of a column, made by the executors."""
    return df.select(F.col(by).alias("_by"), line.alias("value")).orderBy("_by").select("value")


def _write(spark: SparkSession, uri: str, sections: list[str | DataFrame]) -> None:
    """Write one file of lines and tables of lines, in their order.

    Each table is written in pieces by the executors, in range order; one task
    then copies the pieces, byte by byte, to their place. No row passes the driver.
    """
    pieces: list[tuple[str, bool]] = []
    for n, section in enumerate(sections):
        if isinstance(section, str):
            pieces.append((section, False))
        else:
            folder = f"{uri}.parts/{n}"
            section.write.mode("overwrite").text(folder)
            pieces.append((folder, True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            store, path = fs.FileSystem.from_uri(uri)
            with store.open_output_stream(path) as out:
                for what, is_folder in pieces:
                    if not is_folder:
                        out.write((what + "\n").encode())
                        continue
                    found = store.get_file_info(fs.FileSelector(fs.FileSystem.from_uri(what)[1]))
                    for info in sorted(found, key=lambda x: x.path):
                        if info.base_name.startswith("part-") and info.size:
                            with store.open_input_stream(info.path) as piece:
                                while chunk := piece.read(8 << 20):
                                    out.write(chunk)
            if store.get_file_info(f"{path}.parts").type == fs.FileType.Directory:
                store.delete_dir(f"{path}.parts")
            yield batch

    spark.range(1, numPartitions=1).mapInArrow(run, "id long").collect()


def _point(start: str = "") -> Column:
    return F.concat_ws(" ", *([F.lit(start)] if start else []), *(F.col(c).cast("string") for c in "xyz"))


def save_vtk(mesh: Mesh, uri: str, tags: tuple[str, ...] = ()) -> None:
    """VTK legacy ASCII; tags of vertices become point scalars, tags of elements cell scalars. Numbers keep all their digits."""
    spark = mesh.spark
    vertices, elements = _numbered(mesh)
    counts = elements.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("conn") + 1), F.lit(0)).alias("size")).first()
    n = mesh.vertices.count()
    conn = F.col("conn")
    for t, kind in VTK_OF.items():
        if order := VTK_ORDER.get(kind):
            conn = F.when((F.col("etype") == t) & (F.size("conn") == len(order)), F.array(*(F.element_at("conn", i + 1) for i in order))).otherwise(conn)
    kinds = F.create_map(*(F.lit(x) for kv in VTK_OF.items() for x in kv))
    sections: list[str | DataFrame] = ["# vtk DataFile Version 3.0", "mesh", "ASCII", "DATASET UNSTRUCTURED_GRID", f"POINTS {n} double", _lines(vertices, "handle", _point())]
    sections += [f"CELLS {counts['n']} {counts['size']}", _lines(elements, "handle", F.concat_ws(" ", F.size("conn").cast("string"), conn.cast("array<string>")))]
    sections += [f"CELL_TYPES {counts['n']}", _lines(elements, "handle", F.element_at(kinds, F.col("etype").cast("int")).cast("string"))]
    for kind, own, total in (("POINT_DATA", vertices, n), ("CELL_DATA", elements, counts["n"])):
        first = True
        for name in tags:
            values = mesh.tag(name).values.withColumnRenamed("entity", "handle")
            found = own.select("handle").join(values, "handle", "left")
            if found.filter("value IS NOT NULL").isEmpty():
                continue
            sections += [f"{kind} {total}"] * first + [f"SCALARS {name} double 1", "LOOKUP_TABLE default", _lines(found, "handle", F.coalesce(F.col("value").cast("double"), F.lit(0.0)).cast("string"))]
            first = False
    _write(spark, uri, sections)


def save_gmsh(mesh: Mesh, uri: str) -> None:
    """Gmsh 2.2 ASCII."""
    from ..operators.ranges import ranked

    vertices, elements = _numbered(mesh)
    kinds = F.create_map(*(F.lit(x) for kv in GMSH_OF.items() for x in kv))
    rows = ranked(elements, ["handle"], "_n")
    head = F.concat_ws(" ", (F.col("_n") + 1).cast("string"), F.element_at(kinds, F.col("etype").cast("int")).cast("string"), F.lit("2 1 1"))
    sections = ["$MeshFormat", "2.2 0 8", "$EndMeshFormat", "$Nodes", str(mesh.vertices.count()), _lines(vertices, "handle", F.concat_ws(" ", (F.col("index") + 1).cast("string"), _point())), "$EndNodes", "$Elements", str(mesh.elements.count())]
    sections += [_lines(rows, "handle", F.concat_ws(" ", head, F.transform("conn", lambda c: (c + 1).cast("string")))), "$EndElements"]
    _write(mesh.spark, uri, sections)


def save_stl(mesh: Mesh, uri: str) -> None:
    """STL ASCII of all triangles."""
    from ..functions.geometry import V
    from ..operators.measures import triangles

    a, b, c = (V.of(n) for n in "abc")
    up = (b - a).cross(c - a)
    size = up.length()
    normal = F.concat_ws(" ", *(F.when(size > 0, x / size).otherwise(x).cast("string") for x in (up.x, up.y, up.z)))
    corner = lambda v: F.concat_ws(" ", F.lit("vertex"), *(x.cast("string") for x in (v.x, v.y, v.z)))
    line = F.concat_ws("\n", F.concat(F.lit("facet normal "), normal), F.lit("outer loop"), corner(a), corner(b), corner(c), F.lit("endloop"), F.lit("endfacet"))
    _write(mesh.spark, uri, ["solid mesh", _lines(triangles(mesh), "handle", line), "endsolid mesh"])


def save_smf(mesh: Mesh, uri: str) -> None:
    """QSlim SMF of all faces."""
    vertices, elements = _numbered(mesh)
    faces = elements.filter(model.of_dimension(F.col("handle"), 2))
    _write(mesh.spark, uri, [_lines(vertices, "handle", _point("v")), _lines(faces, "handle", F.concat_ws(" ", F.lit("f"), F.transform("conn", lambda c: (c + 1).cast("string"))))])


# Names of cells in GMV files.
GMV_OF = {EDGE: "line", TRI: "tri", QUAD: "quad", TET: "tet", PYRAMID: "pyramid", PRISM: "prism", HEX: "hex"}


def save_gmv(mesh: Mesh, uri: str) -> None:
    """GMV ASCII: nodes by rows, and cells by name."""
    vertices, elements = _numbered(mesh)
    kinds = F.create_map(*(F.lit(x) for kv in GMV_OF.items() for x in kv))
    cell = F.concat_ws(" ", F.element_at(kinds, F.col("etype").cast("int")), F.size("conn").cast("string"), F.transform("conn", lambda c: (c + 1).cast("string")))
    _write(mesh.spark, uri, ["gmvinput ascii", f"nodev {mesh.vertices.count()}", _lines(vertices, "handle", _point()), f"cells {elements.count()}", _lines(elements, "handle", cell), "endgmv"])


def save_ansys(mesh: Mesh, uri: str) -> None:
    """ANSYS preparation commands: a node each line, an element each line (further nodes on continued ones)."""
    vertices, elements = _numbered(mesh)
    from ..operators.ranges import ranked

    node = F.concat_ws(",", F.lit("N"), (F.col("index") + 1).cast("string"), *(F.col(c).cast("string") for c in "xyz"))
    rows = ranked(elements, ["handle"], "_n")
    text = F.transform("conn", lambda c: (c + 1).cast("string"))
    first = F.concat_ws(",", F.lit("EN"), (F.col("_n") + 1).cast("string"), F.slice(text, 1, 8))
    more = F.when(F.size("conn") > 8, F.concat(F.lit("\nEMORE,"), F.concat_ws(",", F.slice(text, 9, 8)))).otherwise("")
    _write(mesh.spark, uri, ["/PREP7", _lines(vertices, "handle", node), _lines(rows, "handle", F.concat(first, more)), "FINISH"])
