"""Large relations are dealt by their size, not by a fixed number of tasks."""

from lattica import model
from lattica.operators import measures
from lattica.plans import tables


def test_boxes_are_made_and_dealt_in_slices(spark, monkeypatch):
    monkeypatch.setattr(model, "SLICE", 16, raising=False)
    mesh = tables.hex_mesh(spark, 6)
    assert mesh.elements.rdd.getNumPartitions() == 14  # 216 elements
    assert measures.centroids(mesh, 3).count() == 216
    assert tables.hex_mesh(spark, 2).elements.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
