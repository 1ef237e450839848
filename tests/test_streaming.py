from pyspark.sql import functions as F

from lattica import model
from lattica.plans import tables
from lattica.streaming import locate_stream


def test_points_arrive_in_batches(spark, tmp_path):
    m = tables.tet_mesh(spark, 1)
    values = m.vertices.select(F.col("handle").alias("entity"), (F.col("x") + 1).alias("value"))
    spark.createDataFrame([(1, 0.25, 0.5, 0.5), (2, 9.0, 0.0, 0.0)], "pid long, x double, y double, z double").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("pid long, x double, y double, z double").parquet(f"{tmp_path}/in")
    got = []
    q = locate_stream(stream, m, model.TET, values, lambda df, n: got.extend((r.pid, r.value) for r in df.collect())).option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    assert got == [(1, 1.25)]
