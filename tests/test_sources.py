"""Readers on literal files, and the native store."""

import struct

import pytest
from pyspark.sql import functions as F

from lattica import model
from lattica.model import HEX, MeshError, mesh_from_arrays
from lattica.sources import files, store

VTK = """# vtk DataFile Version 3.0
two cells
ASCII
DATASET UNSTRUCTURED_GRID
POINTS 8 float
0 0 0 1 0 0 1 1 0 0 1 0
0 0 1 1 0 1 1 1 1 0 1 1
CELLS 2 14
8 0 1 2 3 4 5 6 7
4 0 1 2 3
CELL_TYPES 2
12
9
CELL_DATA 2
SCALARS material int 1
LOOKUP_TABLE default
5 7
POINT_DATA 8
VECTORS flow float
1 2 3 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0
"""
CUBE_CORNER = "solid c\n" + "".join(f"facet normal 0 0 0\nouter loop\n{''.join(f'vertex {x} {y} {z}' + chr(10) for x, y, z in t)}endloop\nendfacet\n" for t in (((0, 0, 0), (1, 0, 0), (0, 1, 0)), ((0, 0, 0), (0, 1, 0), (0, 0, 1)), ((0, 0, 0), (0, 0, 1), (1, 0, 0)), ((1, 0, 0), (0, 1, 0), (0, 0, 1)))) + "endsolid c\n"


def test_vtk():
    p = files.parse_vtk(VTK.encode())
    assert len(p.points) == 8 and [t for t, _ in p.cells] == [HEX, model.QUAD]
    assert ("material", False, 1, 7.0) in p.values and ("flow_2", True, 0, 3.0) in p.values
    grid = files.parse_vtk(b"# vtk DataFile Version 2.0\nx\nASCII\nDATASET STRUCTURED_POINTS\nDIMENSIONS 3 2 2\nORIGIN 1 0 0\nSPACING 2 1 1\n")
    assert len(grid.points) == 12 and len(grid.cells) == 2 and grid.points[2] == (5.0, 0.0, 0.0)
    rect = files.parse_vtk(b"# vtk DataFile Version 2.0\nx\nASCII\nDATASET RECTILINEAR_GRID\nDIMENSIONS 2 2 1\nX_COORDINATES 2 float\n0 3\nY_COORDINATES 2 float\n0 4\nZ_COORDINATES 1 float\n0\n")
    assert rect.cells == [(model.QUAD, [0, 1, 3, 2])]
    with pytest.raises(MeshError):
        files.parse_vtk(VTK.replace("\n12\n", "\n99\n").encode())


def test_wedge_order():
    text = "# vtk DataFile Version 3.0\nx\nASCII\nDATASET UNSTRUCTURED_GRID\nPOINTS 6 float\n" + "0 0 0 " * 6 + "\nCELLS 1 7\n6 0 1 2 3 4 5\nCELL_TYPES 1\n13\n"
    assert files.parse_vtk(text.encode()).cells == [(model.PRISM, [0, 2, 1, 3, 5, 4])]


def test_stl_ascii_and_binary():
    p = files.parse_stl(CUBE_CORNER.encode())
    assert len(p.points) == 4 and len(p.cells) == 4
    tri = [(0, 0, 0), (1, 0, 0), (0, 1, 0)]
    for order in "<>":
        raw = b"\0" * 80 + struct.pack(order + "I", 1) + struct.pack(order + "12fH", 0, 0, 1, *(c for q in tri for c in q), 0)
        assert len(files.parse_stl(raw).points) == 3
    with pytest.raises(MeshError):
        files.parse_stl(b"nothing of that kind")


def test_obj_gmsh_smf():
    o = files.parse_obj(b"o tri\nv 0 0 0\nv 1 0 0\nv 0 1 0\nf 1/1 2/2 3/3\no quad\nv 1 1 0\nf -4 -3 -1 -2\n")
    assert [len(v) for v in o.sets.values()] == [1, 2] and len(o.cells) == 3
    g = files.parse_gmsh(b"$MeshFormat\n2.2 0 8\n$EndMeshFormat\n$Nodes\n4\n5 0 0 0\n6 1 0 0\n7 0 1 0\n8 0 0 1\n$EndNodes\n$Elements\n2\n1 15 2 1 1 5\n2 4 2 9 1 5 6 7 8\n$EndElements\n")
    assert g.cells == [(model.TET, [0, 1, 2, 3])] and g.sets == {"material:9": [0]}
    s = files.parse_smf(b"begin\ntrans 1 0 0\nv 0 0 0\nv 1 0 0\nv 0 1 0\nf 1 2 3\nend\nbegin\nscale 2 2 2\nv 1 1 1\nend\n")
    assert s.points == [(1.0, 0.0, 0.0), (2.0, 0.0, 0.0), (1.0, 1.0, 0.0), (2.0, 2.0, 2.0)] and s.cells == [(model.TRI, [0, 1, 2])]


def test_tetgen_and_nastran(spark, tmp_path):
    p = files.parse_tetgen(b"4 3 1 0\n1 0 0 0 5\n2 1 0 0 6\n3 0 1 0 7\n4 0 0 1 8\n", b"1 4 0\n1 1 2 3 4\n", b"1 0\n1 1 2 3\n")
    assert p.cells == [(model.TET, [0, 1, 2, 3]), (model.TRI, [0, 1, 2])] and p.values[2] == ("attribute_0", True, 2, 7.0)
    (tmp_path / "m.node").write_text("3 3 0 0\n0 0 0 0\n1 1 0 0\n2 0 1 0\n")
    (tmp_path / "m.face").write_text("1 0\n0 0 1 2\n")
    assert files.load_tetgen(spark, f"file://{tmp_path}/m.node").elements.count() == 1
    n = files.parse_nastran(b"BEGIN BULK\nGRID           1             0.0     0.0     0.0\nGRID           2             1.0     0.0     0.0\nGRID,3,,0.0,1.5-1,0.0\nCTRIA3         1       4       1       2       3\nENDDATA\n")
    assert n.points[2] == (0.0, 0.15, 0.0) and n.cells == [(model.TRI, [0, 1, 2])] and n.sets == {"material:4": [0]}


def test_load_files_of_a_folder(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"m{i}.vtk").write_text(VTK)
    m = files.load(spark, str(tmp_path), "vtk")
    assert m.vertices.count() == 24 and m.vertices.select("handle").distinct().count() == 24 and m.elements.count() == 6
    assert sorted(r.value for r in m.tag("material").values.collect()) == [5.0, 5.0, 5.0, 7.0, 7.0, 7.0]
    with pytest.raises(MeshError):
        files.load(spark, str(tmp_path), "vtk", strange="1")
    with pytest.raises(MeshError):
        files.load(spark, str(tmp_path), "unknown")


def test_store_keeps_everything(spark, tmp_path):
    m = mesh_from_arrays(spark, [(0, 0, 0), (1, 0, 0), (0, 1, 0)], [("TRI", [0, 1, 2])])
    s = model.ENTITYSET << model.SHIFT | 1
    m = m.with_(sets=spark.createDataFrame([(s, 2)], "handle long, flags int"), members=m.elements.select(F.lit(s).alias("set"), F.lit(0).cast("long").alias("pos"), F.col("handle").alias("entity")), tags={"T": model.Tag("T", "long", spark.createDataFrame([(1, 5), (s, 6)], "entity long, value long"), 7)})
    store.save(m, str(tmp_path / "s"))
    back = store.load(spark, str(tmp_path / "s"))
    assert back.tag("T").default == 7 and back.elements.collect() == m.elements.collect() and back.links is None
    assert sorted(r.value for r in store.tag_values(str(tmp_path / "s"), spark, "T").collect()) == [5, 6]
    assert store.load_subset(back, {"T": [6]}).vertices.count() == 3
    with pytest.raises(MeshError):
        store.load_subset(back, {"T": [99]})
