"""Registered queries: sets and skins of the model, box sets, parts, options, text readers, tools."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import model
from ..functions import numbering
from ..functions.homogeneous import Coordinate, Transform
from ..model import Tag
from ..operators import adjacency as adj
from ..operators import distribution, entities, mutation, skinning, structured, tags
from ..operators.structured import Box, partition
from ..sources import files, text_formats, util  # noqa: F401  text_formats adds its readers
from ..sources.options import Options
from . import tables as t
from .queries_files import INC, _back, _folder
from .queries_model import SET, handles_of
from .queries_topology import QUAD, half
from .tables import CUSTOMER, NATION, ORDERS_SQL

QUERIES, ORACLE = {}, {}


def H():
    return F.col("handle")


def add(name, run, sql=None):
    QUERIES[name] = run
    if sql:
        ORACLE[name] = sql


# skins, merging, sets ----------------------------------------------------------------------
add("k03_existing_skin", lambda s, d: skinning.existing_skin(_some_edges(s), 2).select("handle"), f"{QUAD}{half('qh', 3, 1)}, f AS (SELECT k, count(*) AS c FROM hf GROUP BY k), made AS (SELECT k, row_number() OVER (ORDER BY k) AS n FROM (SELECT DISTINCT k FROM hf WHERE (elem & {model.ID_MASK}) <= 32)) SELECT {1 << 56} + n AS handle FROM made JOIN f USING (k) WHERE c = 1")
add("k08_geometric_skin", lambda s, d: skinning.geometric_skin(_with_dimensions(t.orders_mesh(s, d))), ORDERS_SQL + f"SELECT DISTINCT m.entity AS handle FROM members m JOIN lnk l ON l.child = m.\"set\" WHERE (l.parent - {SET + NATION}) % 2 = 0 AND m.entity < {SET} AND l.parent >= {SET + NATION}")
add("m06_merge_all", lambda s, d: mutation.merge_map(_stacked(s, d), 0.5), "WITH p AS (SELECT p_partkey + 1 AS handle, p_size AS x, p_partkey % 7 AS y FROM part) SELECT handle, keep FROM (SELECT handle, min(handle) OVER (PARTITION BY x, y) AS keep FROM p) WHERE handle <> keep")
add("d02_shared_sets", lambda s, d: distribution.shared_sets(t.table(s, d, "orders").select((F.col("o_custkey") % 8).alias("part"), F.col("o_orderpriority").alias("value")).unionByName(t.table(s, d, "customer").select((F.col("c_custkey") % 8).alias("part"), F.concat(F.lit("C"), F.col("c_custkey") % 100).alias("value")))), "WITH v AS (SELECT o_custkey % 8 AS part, o_orderpriority AS value FROM orders UNION ALL SELECT c_custkey % 8, 'C' || (c_custkey % 100) FROM customer) SELECT value, count(DISTINCT part) AS n_parts, min(part) AS owner FROM v GROUP BY 1 HAVING count(DISTINCT part) > 1")
add("d08_merge_parts", lambda s, d: distribution.merged_parts(_stacked(s, d).withColumn("part", H() % 4), 0.5), "WITH p AS (SELECT p_partkey + 1 AS handle, p_size AS x, p_partkey % 7 AS y FROM part) SELECT (handle % 4)::BIGINT AS part, handle, min(handle) OVER (PARTITION BY x, y) AS gid FROM p")
add("d07_migration", lambda s, d: distribution.migration(t.orders_mesh(s, d).elements.select("handle"), 3, 5).groupBy("source", "target").agg(F.count("*").alias("n")), ORDERS_SQL + "SELECT source, target, count(*) AS n FROM (SELECT (ntile(3) OVER (ORDER BY handle) - 1)::BIGINT AS source, (ntile(5) OVER (ORDER BY handle) - 1)::BIGINT AS target FROM elem) GROUP BY 1, 2")
add("d11_read_part", lambda s, d: files.part(t.orders_mesh(s, d), 2, 5).elements.select("handle"), ORDERS_SQL + "SELECT handle FROM (SELECT handle, ntile(5) OVER (ORDER BY handle) - 1 AS p FROM elem) WHERE p = 2")
add("d11_read_part_vertices", lambda s, d: files.part(t.orders_mesh(s, d), 2, 5).vertices.select("handle"), ORDERS_SQL + "SELECT DISTINCT vertex AS handle FROM inc JOIN (SELECT handle, ntile(5) OVER (ORDER BY handle) - 1 AS p FROM elem) ON handle = elem WHERE p = 2")
for _op, _sql in (("!=", "<>"), ("<", "<"), (">=", ">=")):
    add(f"t11_compare_{ {'!=': 'unequal', '<': 'less', '>=': 'at_least'}[_op] }", lambda s, d, op=_op: tags.compared(t.orders_mesh(s, d), "PRICE", op, 15000000), ORDERS_SQL + f"SELECT handle FROM eo WHERE round(o_totalprice * 100)::BIGINT {_sql} 15000000")
add("t11_compare_bytes", lambda s, d: tags.compared_bytes(t.orders_mesh(s, d), "PRIORITY", b"1-URGENT"), ORDERS_SQL + "SELECT handle FROM eo WHERE o_orderpriority = '1-URGENT'")
add("q12_coordinate_blocks", lambda s, d: entities.coordinate_blocks(t.orders_mesh(s, d), _doubled), ORDERS_SQL + "SELECT handle, x * 2 AS x, y * 2 AS y, z * 2 AS z FROM vtx")
add("q12_connectivity_blocks", lambda s, d: entities.connectivity_blocks(t.orders_mesh(s, d), model.TRI, _turned_back).select("handle", F.array_join("conn", ",").alias("conn")), ORDERS_SQL + "SELECT handle, conn[3] || ',' || conn[2] || ',' || conn[1] AS conn FROM elem WHERE etype = 2")
add("m11_rollback", lambda s, d: _failed_read(s, d), ORDERS_SQL + "SELECT 'FAILURE' AS code, (SELECT count(*) FROM elem) AS elements")
add("a14_split_shared", lambda s, d: mutation.split_shared(t.quad_mesh(s, 8), 2, _seam(s)).vertices.agg(F.count("*").alias("n")), "SELECT (81 + 9)::BIGINT AS n")
add("a14_split_skin", lambda s, d: skinning.skin_vertices(mutation.split_shared(t.quad_mesh(s, 8), 2, _seam(s)), 2).agg(F.count("*").alias("n")), "SELECT 2 * (2 * (8 + 4))::BIGINT AS n")


def _some_edges(s):
    m = t.quad_mesh(s, 8)
    return adj.create_missing(m, m.elements.filter(model.id_of(H()) <= 32).select("handle"), 1)


def _with_dimensions(m):
    values = m.links.filter(F.col("parent") >= SET + NATION).select(F.col("child").alias("entity"), F.when((F.col("parent") - SET - NATION) % 2 == 0, 2).otherwise(3).alias("value"))
    return m.with_(tags=m.tags | {"GEOM_DIMENSION": Tag("GEOM_DIMENSION", "int", values)})


def _stacked(s, d):
    return t.table(s, d, "part").select((F.col("p_partkey") + 1).alias("handle"), F.col("p_size").cast("double").alias("x"), (F.col("p_partkey") % 7).cast("double").alias("y"), F.lit(0.0).alias("z"))


def _doubled(handles, coords):
    return coords * 2


def _turned_back(handles, conn):
    return conn[:, ::-1]


def _failed_read(s, d):
    m = t.orders_mesh(s, d)
    code = "SUCCESS"
    try:
        files.PARSERS["vtk"](b"not a mesh file")
    except model.MeshError as e:
        code = e.code
    return m.elements.agg(F.count("*").alias("elements")).select(F.lit(code).alias("code"), "elements")


def _seam(s):
    """Edges of the grid's middle line, which cut it in two."""
    x = Box((0, 0, 0), (8, 8, 0)).vertices(s).filter("j = 4").select("handle", "i")
    other = x.select(F.col("handle").alias("b"), (F.col("i") - 1).alias("i"))
    return x.join(other, "i").select(F.array_sort(F.array("handle", "b")).alias("key"))


# boxes -----------------------------------------------------------------------------------
_two = (Box((0, 0, 0), (4, 3, 2)), Box((4, 0, 0), (7, 3, 2), first_vertex=61, first_element=25))


def _boxed(s):
    m = _two[0].mesh(s)
    other = _two[1].mesh(s)
    m = m.with_(vertices=m.vertices.unionByName(other.vertices), elements=m.elements.unionByName(other.elements))
    for b in _two:
        m, _ = structured.add_box(m, b)
    return m


add("k14_find_boxes", lambda s, d: s.createDataFrame([(h, *b.low, *b.high, b.first_vertex, b.first_element) for h, b in structured.find_boxes(_boxed(s))], "handle long, i0 long, j0 long, k0 long, i1 long, j1 long, k1 long, first_vertex long, first_element long"), f"SELECT * FROM (VALUES ({SET + 1}::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 4::BIGINT, 3::BIGINT, 2::BIGINT, 1::BIGINT, 1::BIGINT), ({SET + 2}, 4, 0, 0, 7, 3, 2, 61, 25)) v(handle, i0, j0, k0, i1, j1, k1, first_vertex, first_element)")
add("k14_box_of", lambda s, d: structured.box_of(m := _boxed(s), m.elements.select("handle")).groupBy("set").agg(F.count("*").alias("n")), f"SELECT * FROM (VALUES ({SET + 1}::BIGINT, 24::BIGINT), ({SET + 2}, 18)) v(\"set\", n)")
add("k14_box_members", lambda s, d: _boxed(s).members.groupBy("set").agg(F.count("*").alias("n")), f"SELECT * FROM (VALUES ({SET + 1}::BIGINT, 84::BIGINT), ({SET + 2}, 66)) v(\"set\", n)")
add("k14_remove_box", lambda s, d: s.createDataFrame([(h,) for h, _ in structured.find_boxes(structured.remove_box(_boxed(s), SET + 1))], "handle long"), f"SELECT {SET + 2}::BIGINT AS handle")
add("k16_shared_vertices", lambda s, d: structured.shared_vertices(s, list(_two)), "SELECT p.part, 1 - p.part AS other, CASE WHEN p.part = 0 THEN 1 + 4 + 5*j + 20*k ELSE 61 + 4*j + 16*k END AS handle, CASE WHEN p.part = 1 THEN 1 + 4 + 5*j + 20*k ELSE 61 + 4*j + 16*k END AS twin FROM range(2) p(part), range(4) a(j), range(3) b(k)")
add("k16_partition_shares", lambda s, d: structured.shared_vertices(s, [Box(lo, hi) for lo, hi in partition((0, 0, 0), (6, 6, 6), 3)]).groupBy("part", "other").agg(F.count("*").alias("n")), "SELECT a AS part, b AS other, 49::BIGINT AS n FROM range(3) x(a), range(3) y(b) WHERE abs(a - b) = 1")
_TURN = Transform.from_points((Coordinate(0, 0, 0), Coordinate(3, 0, 0), Coordinate(0, 2, 0)), (Coordinate(5, 1, 2), Coordinate(5, 4, 2), Coordinate(3, 1, 2)))
add("k17_transform", lambda s, d: t.box(3).vertices(s).select("handle", *(c.cast("long").alias(n) for n, c in zip("ijk", _TURN.columns(F.col("i"), F.col("j"), F.col("k"))))), f"WITH {t.hex_sql(3)} SELECT handle, 5 - j AS i, 1 + i AS j, 2 + k AS k FROM bv")
add("k17_inverse", lambda s, d: t.box(3).vertices(s).select("handle", *(c.cast("long").alias(n) for n, c in zip("ijk", (_TURN.inverse() @ _TURN).columns(F.col("i"), F.col("j"), F.col("k"))))), f"WITH {t.hex_sql(3)} SELECT handle, i, j, k FROM bv")


# options and reader helpers -----------------------------------------------------------------
def _options(s):
    o = Options.parse(";,FLAG,Count=12,SIZE=2.5e-1,IDS=1,4-6,x,NAMES=a")
    p = Options.parse("FLAG;Count=12;SIZE=2.5e-1;IDS=1,4-6;NAMES=a,b;MODE=fast;ON;LEFT=1")
    rows = [("flag", str(p.flag("flag")).lower()), ("count", str(p.integer("COUNT"))), ("size", str(p.real("Size"))), ("ids", ",".join(map(str, p.integers("ids")))), ("names", "|".join(p.texts("NAMES"))), ("mode", str(p.choice("mode", ["slow", "FAST"]))), ("on", str(p.toggle("on")).lower()), ("unseen", ",".join(p.unseen())), ("separator", str(o.integer("count")))]
    try:
        p.done()
    except model.MeshError as e:
        rows.append(("error", e.code))
    return s.createDataFrame(rows, "name string, value string")


add("f23_options", lambda s, d: _options(s), "SELECT * FROM (VALUES ('flag', 'true'), ('count', '12'), ('size', '0.25'), ('ids', '1,4,5,6'), ('names', 'a|b'), ('mode', '1'), ('on', 'true'), ('unseen', 'LEFT'), ('separator', '12'), ('error', 'UNHANDLED_OPTION')) v(name, value)")
add("f23_read_part", lambda s, d: _load_with(s, "PARALLEL=READ_PART;RANK=1;RANKS=4;NO_TAGS").elements.select("handle"), f"SELECT {3 << 56} + i AS handle FROM range(17, 33) r(i)")
add("f24_gathered_nodes", lambda s, d: util.gathered_nodes(m := t.orders_mesh(s, d), handles_of(m, "etype = 3")), ORDERS_SQL + "SELECT handle, x, y, z FROM vtx WHERE handle IN (SELECT vertex FROM inc WHERE (elem >> 56) = 3)")
add("f24_assigned_ids", lambda s, d: util.assigned_ids(t.orders_mesh(s, d).elements.select("handle"), 10), ORDERS_SQL + "SELECT handle, row_number() OVER (ORDER BY handle) + 9 AS id FROM elem")
add("f24_numbered_connectivity", lambda s, d: util.numbered_connectivity(m := t.orders_mesh(s, d), util.assigned_ids(m.vertices.select("handle"), 0)).select("handle", F.array_join("conn", ",").alias("conn")), ORDERS_SQL + ", ids AS (SELECT handle AS v, row_number() OVER (ORDER BY handle) - 1 AS id FROM vtx) SELECT elem AS handle, string_agg(id, ',' ORDER BY pos) AS conn FROM inc JOIN ids ON v = vertex GROUP BY 1")
add("f24_reordered", lambda s, d: util.reordered(t.hex_mesh(s, 4).elements, (0, 3, 2, 1, 4, 7, 6, 5)).select("handle", F.array_join("conn", ",").alias("conn")), f"WITH {t.hex_sql(4)} SELECT handle, array_to_string([conn[1], conn[4], conn[3], conn[2], conn[5], conn[8], conn[7], conn[6]], ',') AS conn FROM bh")
add("f24_from_arrays", lambda s, d: _from_arrays(s), f"WITH {t.quad_sql(8)} SELECT handle, array_to_string(conn, ',') AS conn FROM qh")


def _load_with(s, options):
    uri = f"{_folder(s)}/mesh.vtk"
    files.save_vtk(t.quad_mesh(s, 8), uri)
    return files.load(s, uri, options=options)


def _from_arrays(s):
    import numpy as np

    i, j = np.meshgrid(np.arange(8), np.arange(8))
    at = (i + 9 * j).ravel()
    return util.element_connectivity(s, model.QUAD, np.stack([at, at + 1, at + 10, at + 9], 1)).select("handle", F.array_join("conn", ",").alias("conn"))


# text readers -------------------------------------------------------------------------------
def _text(s, suffix, text):
    from pyarrow import fs

    uri = f"{_folder(s)}/mesh.{suffix}"
    store, path = fs.FileSystem.from_uri(uri)
    with store.open_output_stream(path) as out:
        out.write(text.encode())
    return uri


def _grid(n, z=1):
    """Points of a box of ``n`` cells a side as the generated meshes have them, skewed alike, and its cells."""
    r = range(n + 1)
    points = [(i * 4 + (j * k) % 3, j * 4 + i % 2, k * 4 + (i + j) % 2) for k in r for j in r for i in r]
    at = lambda i, j, k: 1 + i + (n + 1) * (j + (n + 1) * k)
    ring = ((0, 0), (1, 0), (1, 1), (0, 1))
    cells = [[at(i + a, j + b, k + c) for c in (0, 1) for a, b in ring] for k in range(n) for j in range(n) for i in range(n)]
    return points, cells


def _lines(rows):
    return "\n".join(rows) + "\n"


def _obj():
    points = [(i * 3, j * 3, (i * j) % 4) for j in range(9) for i in range(9)]
    faces = [(1 + i + 9 * j, 2 + i + 9 * j, 11 + i + 9 * j, 10 + i + 9 * j) for j in range(8) for i in range(8)]
    return _lines(["# grid", "o sheet", *(f"v {x} {y} {z}" for x, y, z in points), *(f"f {a}/1 {b}/1 {c}/1 {e}/1" for a, b, c, e in faces)])


def _nastran():
    points, cells = _grid(3)
    return _lines(["BEGIN BULK", *(f"GRID,{i},,{x}.,{y}.,{z}." for i, (x, y, z) in enumerate(points, 1)), *(f"CHEXA,{i},7,{','.join(map(str, c[:6]))}\n+,{c[6]},{c[7]}" for i, c in enumerate(cells, 1)), "ENDDATA"])


def _tetgen(s):
    points, cells = _grid(3)
    tets = [[c[v] for v in k] for c in cells for k in t.SIX_TETS]
    node = _text(s, "node", _lines([f"{len(points)} 3 0 0", *(f"{i} {x} {y} {z}" for i, (x, y, z) in enumerate(points, 1))]))
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(node.removesuffix(".node") + ".ele")
    with store.open_output_stream(path) as out:
        out.write(_lines([f"{len(tets)} 4 0", *(f"{i} {' '.join(map(str, c))}" for i, c in enumerate(tets, 1))]).encode())
    return files.load_tetgen(s, node)


def _abaqus():
    points, cells = _grid(3)
    return _lines(["*HEADING", "box", "*NODE, NSET=ALL", *(f"{i}, {x}., {y}., {z}." for i, (x, y, z) in enumerate(points, 1)), "*ELEMENT, TYPE=C3D8R, ELSET=BODY", *(f"{i}, {', '.join(map(str, c[:5]))},\n{', '.join(map(str, c[5:]))}" for i, c in enumerate(cells, 1)), "*NSET, NSET=LOW, GENERATE", "1, 16, 1", "*ELSET, ELSET=FIRST", "1, 2, 3", "*END STEP"])


def _ideas():
    points, cells = _grid(3)
    nodes = [f"{i:10d}{1:10d}{1:10d}{11:10d}\n{x:25.16E}{y:25.16E}{z:25.16E}".replace("E", "D") for i, (x, y, z) in enumerate(points, 1)]
    elements = [f"{i:10d}{115:10d}{1:10d}{4:10d}{7:10d}{8:10d}\n{''.join(f'{v:10d}' for v in c)}" for i, c in enumerate(cells, 1)]
    return _lines(["    -1", "  2411", *nodes, "    -1", "    -1", "  2412", *elements, "    -1"])


def _rtt():
    points, cells = _grid(3)
    tets = [[c[v] for v in k] for c in cells for k in t.SIX_TETS]
    return _lines(["rtt_ascii", "header", "version v1.0.1", "title box", "end_header", "dims", f"nnodes {len(points)}", "nsides 0", f"ncells {len(tets)}", "end_dims", "nodes", *(f"{i} {x} {y} {z} 0" for i, (x, y, z) in enumerate(points, 1)), "end_nodes", "cells", *(f"{i} 4 {' '.join(map(str, c))} {1 + i % 2}" for i, c in enumerate(tets, 1)), "end_cells", "end_rtt_mesh"])


def _meshtal():
    """A rectangular tally of 3 by 2 by 2 cells; the value of a cell is its number."""
    rows = [f"  {0.5 + i:9.3f} {0.5 + j:9.3f} {0.5 + k:9.3f} {float(1 + k + 2 * j + 4 * i):12.5E} {0.1:9.4f}" for i in range(3) for j in range(2) for k in range(2)]
    return _lines(["mcnp   version 5     ld=11082000  probid =  03/07/08", " a title", " Number of histories used for normalizing tallies =      50000000.00", "", " Mesh Tally Number         4", " neutron mesh tally.", "", " Tally bin boundaries:", "    X direction:      0.00      1.00      2.00      3.00", "    Y direction:      0.00      1.00      2.00", "    Z direction:      0.00      1.00      2.00", "    Energy bin boundaries: 0.00E+00 1.00E+36", "", "   X         Y         Z     Result     Rel Error", *rows])


add("f04_obj", lambda s, d: _back(files.load(s, _text(s, "obj", _obj()))), f"WITH {t.tri_sql(8, True)} " + INC.format(cells="qt", points="qv"))
add("f08_nastran", lambda s, d: _back(files.load(s, _text(s, "nas", _nastran()))), f"WITH {t.hex_sql(3, True)} " + INC.format(cells="bh", points="bv"))
add("f07_tetgen", lambda s, d: _back(_tetgen(s)), f"WITH {t.tet_sql(3, True)} " + INC.format(cells="bt", points="bv"))
add("f09_abaqus", lambda s, d: _back(files.load(s, _text(s, "abq", _abaqus()))), f"WITH {t.hex_sql(3, True)} " + INC.format(cells="bh", points="bv"))
add("f09_abaqus_sets", lambda s, d: _set_sizes(files.load(s, _text(s, "abq", _abaqus()))), "SELECT * FROM (VALUES ('BODY', 27::BIGINT), ('FIRST', 3), ('LOW', 16), ('ALL', 64)) v(name, n)")
add("f10_ideas", lambda s, d: _back(files.load(s, _text(s, "unv", _ideas()))), f"WITH {t.hex_sql(3, True)} " + INC.format(cells="bh", points="bv"))
add("f11_tally", lambda s, d: _tally(files.load(s, _text(s, "meshtal", _meshtal()))), f"SELECT {9 << 56} + 1 + i + 3*j + 6*k AS handle, i + 0.5::DOUBLE AS x, j + 0.5::DOUBLE AS y, k + 0.5::DOUBLE AS z, (1 + k + 2*j + 4*i)::DOUBLE AS value FROM range(3) a(i), range(2) b(j), range(2) c(k)")
add("f12_rtt", lambda s, d: _back(files.load(s, _text(s, "rtt", _rtt()))), f"WITH {t.tet_sql(3, True)} " + INC.format(cells="bt", points="bv"))
add("f13_sms", lambda s, d: _back(_faces_only(files.load(s, _text(s, "sms", _sms())))), f"WITH {t.tri_sql(8, True)} " + INC.format(cells="qt", points="qv"))
add("f19_gmv", lambda s, d: _gmv_lines(s), "SELECT 'nodev' AS word, 125::BIGINT AS n UNION ALL SELECT 'cells', 64 UNION ALL SELECT 'hex', 64")
add("f19_ansys", lambda s, d: _ansys_lines(s), "SELECT 'N' AS word, 125::BIGINT AS n UNION ALL SELECT 'EN', 64")


def _set_sizes(m):
    return m.members.join(m.tags["NAME"].values.select(F.col("entity").alias("set"), F.col("value").alias("name")), "set").groupBy("name").agg(F.count("*").alias("n"))


def _tally(m):
    from ..operators.measures import centroids

    return centroids(m, 3).join(m.tags["TALLY_4"].values.withColumnRenamed("entity", "handle"), "handle").select("handle", "x", "y", "z", "value")


def _sms():
    """Vertices, edges by vertices, faces by edges; faces of two triangles a square."""
    points = [(i * 3, j * 3, (i * j) % 4) for j in range(9) for i in range(9)]
    tris = [c for j in range(8) for i in range(8) for v in [(1 + i + 9 * j, 2 + i + 9 * j, 11 + i + 9 * j, 10 + i + 9 * j)] for c in ((v[0], v[1], v[2]), (v[0], v[2], v[3]))]
    edges: dict[tuple[int, int], int] = {}
    faces = []
    for c in tris:
        own = []
        for a, b in ((c[2], c[0]), (c[0], c[1]), (c[1], c[2])):
            key = (min(a, b), max(a, b))
            if key not in edges:
                edges[key] = len(edges) + 1
            own.append(edges[key] if key == (a, b) else -edges[key])
        faces.append(own)
    head = ["sms 2", f"0 {len(faces)} {len(edges)} {len(points)} {len(points)}"]
    return _lines([*head, *(f"1 3 0\n{x} {y} {z}" for x, y, z in points), *(f"1 2 {a} {b} 0 0" for a, b in edges), *(f"1 2 3 {' '.join(map(str, f))} 0" for f in faces)])


def _faces_only(m):
    return m.with_(elements=m.elements.filter(model.of_type(H(), model.TRI)))


def _count_words(s, uri):
    words = s.read.text(uri).select(F.element_at(F.split(F.regexp_replace(F.trim("value"), ",", " "), r"\s+"), 1).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


def _gmv_lines(s):
    uri = f"{_folder(s)}/mesh.gmv"
    files.save_gmv(t.hex_mesh(s, 4), uri)
    rows = s.read.text(uri)
    got = F.regexp_extract(F.col("value"), r"^(nodev|cells)\s+(\d+)", 2)
    head = rows.filter(got != "").select(F.regexp_extract("value", r"^(\w+)", 1).alias("word"), got.cast("long").alias("n"))
    return head.unionByName(_count_words(s, uri).filter("word = 'hex'"))


def _ansys_lines(s):
    uri = f"{_folder(s)}/mesh.ans"
    files.save_ansys(t.hex_mesh(s, 4), uri)
    return _count_words(s, uri).filter("word IN ('N', 'EN')")
