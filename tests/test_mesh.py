"""Literal fixtures, invariants and error rules of the mesh engine."""

import math

import pytest
from pyspark.sql import functions as F

from lattica import model
from lattica.functions import numbering, quality
from lattica.functions.geometry import V
from lattica.model import HEX, QUAD, TET, TRI, MeshError, mesh_from_arrays
from lattica.operators import adjacency, entities, fields, fixpoint, measures, mutation, ranges, sets, skinning, tags
from lattica.operators.structured import Box
from lattica.plans import tables


@pytest.fixture(scope="module")
def triangle(spark):
    return mesh_from_arrays(spark, [(0, 0, 0), (1, 0, 0), (1, 1, 1)], [("TRI", [0, 1, 2])])


def values(df, *cols):
    return sorted(tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect())


def test_one_triangle(spark, triangle):
    tri = triangle.elements.select("handle")
    assert values(adjacency.adjacencies(triangle, tri, 0), "handle") == [1, 2, 3]
    pos = measures.average_position(triangle, tri).first()
    assert pos["x"] == pytest.approx(2 / 3) and pos["z"] == pytest.approx(1 / 3)
    assert adjacency.create_missing(triangle, tri, 1).elements.filter("etype = 1").count() == 3


def test_two_by_two_quads(spark):
    m = Box((0, 0, 0), (2, 2, 0)).mesh(spark)
    assert skinning.skin_facets(m, 2).count() == 8 and skinning.skin_vertices(m, 2).count() == 8


def test_geometric_skin(spark):
    m = Box((0, 0, 0), (2, 2, 0)).mesh(spark)
    s = lambda i: (model.ENTITYSET << model.SHIFT) | i
    members = m.elements.select(F.lit(s(1)).alias("set"), F.lit(0).cast("long").alias("pos"), F.col("handle").alias("entity")).unionByName(m.vertices.filter("handle < 9").select(F.lit(s(1)).alias("set"), F.lit(0).cast("long").alias("pos"), F.col("handle").alias("entity")))
    m = m.with_(sets=spark.createDataFrame([(s(1), 2), (s(2), 2)], "handle long, flags int"), members=members, links=spark.createDataFrame([(s(2), s(1), 0)], "parent long, child long, pos int"))
    m, _ = tags.get_handle(m, "GEOM_DIMENSION", "int", flags=frozenset({"creat"}))
    with pytest.raises(MeshError):
        skinning.geometric_skin(m)
    m = tags.set_data(m, "GEOM_DIMENSION", spark.createDataFrame([(s(1), 2), (s(2), 3)], "entity long, value int"))
    got = ranges.counts(skinning.geometric_skin(m))
    assert values(got, "etype", "n") == [(0, 8), (3, 4)]


def test_box_with_given_coordinates(spark):
    xs = F.element_at(F.array(*map(F.lit, (-1.0, 3.0, 5.0))), (F.col("i") + 1).cast("int"))
    m = Box((0, 0, 0), (2, 1, 1)).mesh(spark, (xs, F.col("j"), F.col("k") * 2 - 1))
    assert m.vertices.count() == 12 and m.elements.count() == 2
    assert measures.quality_of(m, HEX, ["volume"]).agg(F.sum("volume")).first()[0] == pytest.approx(12.0)


def test_euler_characteristic_of_a_closed_skin(spark):
    m = Box((0, 0, 0), (3, 3, 3)).mesh(spark)
    v, e, f = skinning.skin_vertices(m, 3).count(), skinning.skin_by_dimension(m, 3, 1).count(), skinning.skin_facets(m, 3).count()
    assert f == 6 * 9 and v - e + f == 2


def test_structured_skin_equals_the_general_one(spark):
    b = Box((2, 3, 4), (5, 6, 8))
    general = skinning.skin_facets(b.mesh(spark), 3).select("elem", "side")
    assert general.exceptAll(b.skin(spark)).isEmpty() and b.skin(spark).exceptAll(general).isEmpty()


def test_adjacency_is_symmetric_and_union_holds_intersection(spark):
    m = Box((0, 0, 0), (3, 3, 1)).mesh(spark)
    n = adjacency.neighbours(m, 3)
    assert n.join(n.select(F.col("other").alias("elem"), F.col("elem").alias("other")), ["elem", "other"], "left_anti").isEmpty()
    src = m.vertices.filter("handle IN (6, 7)").select("handle")
    union, both = adjacency.adjacencies(m, src, 3), adjacency.adjacencies(m, src, 3, "intersect")
    assert ranges.contains(union, both).first()[0] and both.count() < union.count()


def test_refinement_keeps_volume(spark):
    m = Box((0, 0, 0), (2, 1, 1)).mesh(spark)
    fine = mutation.refine(m, HEX)
    q = measures.quality_of(fine, HEX, ["volume", "jacobian"]).agg(F.sum("volume"), F.min("jacobian")).first()
    assert q[0] == pytest.approx(2.0) and q[1] > 0


def test_ideal_elements_have_ideal_metrics(spark):
    r3, r6 = math.sqrt(3), math.sqrt(6)
    shapes = {
        TRI: ([(0, 0, 0), (1, 0, 0), (0.5, r3 / 2, 0)], {"edge_ratio": 1, "aspect_ratio": 1, "radius_ratio": 1, "aspect_frobenius": 1, "area": r3 / 4, "minimum_angle": 60, "maximum_angle": 60, "condition": 1, "scaled_jacobian": 1, "shape": 1}),
        QUAD: ([(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0)], {"edge_ratio": 1, "max_edge_ratio": 1, "aspect_ratio": 1, "radius_ratio": 1, "med_aspect_frobenius": 1, "max_aspect_frobenius": 1, "skew": 0, "taper": 0, "warpage": 1, "area": 1, "stretch": 1, "maximum_angle": 90, "oddy": 0, "condition": 1, "jacobian": 1, "scaled_jacobian": 1, "shear": 1, "shape": 1}),
        TET: ([(0, 0, 0), (1, 0, 0), (0.5, r3 / 2, 0), (0.5, r3 / 6, r6 / 3)], {"edge_ratio": 1, "scaled_jacobian": 1, "radius_ratio": 1, "aspect_beta": 1, "aspect_ratio": 1, "aspect_gamma": 1, "aspect_frobenius": 1, "minimum_angle": math.degrees(math.acos(1 / 3)), "collapse_ratio": 1, "volume": math.sqrt(2) / 12, "condition": 1, "jacobian": math.sqrt(2) / 2, "shape": 1}),
        HEX: ([(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)], {"edge_ratio": 1, "max_edge_ratio": 1, "skew": 0, "taper": 0, "volume": 1, "stretch": 1, "diagonal": 1, "oddy": 0, "med_aspect_frobenius": 1, "max_aspect_frobenius": 1, "condition": 1, "jacobian": 1, "scaled_jacobian": 1, "shear": 1, "shape": 1}),
    }
    for etype, (points, want) in shapes.items():
        assert set(want) | {"relative_size", "shape_and_size", "shear_and_size"} >= set(quality.available(etype))
        p = [V.const(*q) for q in points]
        got = spark.range(1).select(*(quality.METRICS[etype][n](p, None).alias(n) for n in want)).first()
        assert got.asDict() == pytest.approx(want, abs=1e-9), etype
    with pytest.raises(MeshError):
        quality.measure(TET, "distortion", F.lit(None), 4)
    with pytest.raises(MeshError):
        quality.tri_relative_size([V.const(*q) for q in shapes[TRI][0]])


def test_edge_length(spark):
    m = mesh_from_arrays(spark, [(0, 0, 0), (1, 1, 1)], [("EDGE", [0, 1])])
    assert measures.quality_of(m, model.EDGE, ["length"]).first()["length"] == pytest.approx(1.732050807568877)


def test_tag_rules(spark, triangle):
    m, t = tags.get_handle(triangle, "A", "int", flags=frozenset({"creat"}), default=3)
    for change, code in (({"flags": frozenset({"excl"})}, "ALREADY_ALLOCATED"), ({"length": 2}, "INVALID_SIZE"), ({"dtype": "double"}, "TYPE_OUT_OF_RANGE"), ({"default": 4}, "ALREADY_ALLOCATED"), ({"flags": frozenset({"store"}), "storage": "dense"}, "TYPE_OUT_OF_RANGE")):
        with pytest.raises(MeshError) as e:
            tags.get_handle(m, "A", **{"dtype": "int", **change})
        assert e.value.code == code
    with pytest.raises(MeshError):
        tags.get_handle(m, "B", "int")
    assert values(tags.get_data(m, "A", m.elements.select("handle")), "value") == [3]
    m2, _ = tags.get_handle(m, "NO_DEFAULT", "int", flags=frozenset({"creat"}))
    with pytest.raises(Exception, match="TAG_NOT_FOUND"):
        tags.get_data(m2, "NO_DEFAULT", m.elements.select("handle")).collect()
    with pytest.raises(MeshError):
        tags.length_of(model.Tag("V", "int", None, length=0))
    nan = tags.set_data(tags.get_handle(m, "D", "double", flags=frozenset({"creat"}))[0], "D", spark.createDataFrame([(1, float("nan")), (2, 1.0)], "entity long, value double"))
    assert tags.with_value(nan, "D", float("nan")).count() == 0 and tags.with_value(nan, "D", 1.0).count() == 1


def test_cyclic_sets(spark, triangle):
    s = lambda i: (model.ENTITYSET << model.SHIFT) | i
    m = triangle.with_(sets=spark.createDataFrame([(s(i), 2) for i in (1, 2, 3)], "handle long, flags int"), members=spark.createDataFrame([(s(1), 0, s(2)), (s(2), 0, s(3)), (s(3), 0, s(1)), (s(3), 0, 1)], "set long, pos long, entity long"))
    assert values(entities.by_handle(m, s(1), True), "handle") == [1]
    assert values(sets.contained(m, s(1), 0), "handle") == [s(2), s(3)]


def test_connectivity_match(spark):
    row = lambda a, b: spark.range(1).select(numbering.match(F.array(*map(F.lit, a)), F.array(*map(F.lit, b))).alias("m")).first()["m"]
    assert tuple(row([1, 2, 3], [2, 3, 1])) == (True, 1, 2)
    assert tuple(row([1, 2, 3], [3, 2, 1])) == (True, -1, 2)
    assert not row([1, 2, 3], [1, 2, 4])[0]
    assert numbering.side_of(HEX, (0, 1, 5, 4)) == (0, 1, 0) and numbering.side_of(TET, (2, 0, 1)) == (3, -1, 1)
    assert numbering.side_of(HEX, (0, 1, 6, 7)) is None and numbering.opposite_side(TET, 2, 0) == (0, 2)


def test_merging_is_by_distance_and_not_transitive(spark):
    pts = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 0.9, 0.0, 0.0), (3, 1.8, 0.0, 0.0), (4, 9.0, 0.0, 0.0)], "handle long, x double, y double, z double")
    assert values(mutation.merge_map(pts, 1.0), "handle", "keep") == [(2, 1)] or values(mutation.merge_map(pts, 1.0), "handle", "keep") == [(2, 3)]
    assert mutation.merge_map(pts, 0.9).count() <= 1  # the bound itself is outside


def test_higher_order_nodes_come_and_go(spark):
    m = tables.tet_mesh(spark, 1)
    up = mutation.add_mid_edge_nodes(m, 3)
    assert {len(r["conn"]) for r in up.elements.collect()} == {10} and numbering.mid_nodes(TET, 10) == (True, False, False)
    assert mutation.remove_higher_order(up).vertices.count() == m.vertices.count()


def test_interpolation_is_exact_for_linear_fields(spark):
    m = tables.tet_mesh(spark, 2)
    pts = spark.createDataFrame([(1, 0.3, 0.4, 1.7), (2, 1.0, 1.0, 1.0), (3, 5.0, 0.0, 0.0)], "pid long, x double, y double, z double")
    vals = m.vertices.select(F.col("handle").alias("entity"), (F.col("x") + 2 * F.col("y") - F.col("z")).alias("value"))
    got = {r.pid: r.value for r in fields.couple(m, pts, TET, vals).collect()}
    assert got == {1: pytest.approx(-0.6), 2: pytest.approx(2.0)}


def test_bad_arguments(spark, triangle):
    with pytest.raises(MeshError):
        model.type_from_name("nothing")
    with pytest.raises(MeshError):
        mutation.refine(triangle, model.PYRAMID)
    with pytest.raises(MeshError):
        mutation.merge_entities(triangle, 1, (TRI << model.SHIFT) | 1)
    with pytest.raises(MeshError):
        entities.by_type_and_tag(triangle, TRI, [], op="xor")


def _endless(rounds):
    """Stands for ``store``: every round has rows until so many were stored."""
    from unittest.mock import MagicMock

    fronts = []

    def store(spark, df):
        fronts.append(MagicMock())
        fronts[-1].isEmpty.return_value = len(fronts) > rounds
        return fronts[-1]

    return fronts, store


def test_reach_and_depth_have_no_most_rounds(spark, monkeypatch):
    from unittest.mock import MagicMock

    fronts, store = _endless(1500)
    monkeypatch.setattr(fixpoint, "store", store)
    fixpoint.reach(MagicMock(), MagicMock())
    assert len(fronts) > 1500
    fronts, store = _endless(1500)
    monkeypatch.setattr(skinning, "store", store)
    monkeypatch.setattr(skinning, "skin_vertices", MagicMock())
    skinning.depth(MagicMock(), 2)
    assert len(fronts) > 1500


def test_merged_rounds_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(fixpoint, "MERGED", 2)
    monkeypatch.setattr(skinning, "MERGED", 2)
    edges = spark.createDataFrame([(i, i + 1) for i in range(7)] + [(7, 3)], "src long, dst long")
    got = fixpoint.reach(spark.createDataFrame([(0,)], "node long"), edges)
    assert values(got, "node", "hop") == [(i, i) for i in range(8)]
    deep = skinning.depth(Box((0, 0, 0), (9, 9, 0)).mesh(spark), 2)
    assert sorted(r.depth for r in deep.collect()) == sorted(min(i, j, 8 - i, 8 - j) for i in range(9) for j in range(9))
