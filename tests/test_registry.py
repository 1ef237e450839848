"""Registered queries against their SQL, on the smallest tables (a part of them, spread over all families)."""

import glob
import os

import duckdb
import pytest

from lattica.plans import registry

DATA = "/root/testdata/sf0.001"
CHOSEN = sorted(registry.ORACLE)[::6]


def test_names():
    assert set(registry.ORACLE) <= set(registry.QUERIES)


def test_entry_points():
    import __spark_entry__ as e

    assert set(registry.QUERIES) <= set(e.queries()) and set(registry.ORACLE) <= set(e.oracle_sql())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    try:
        want = con.execute(registry.ORACLE[name]).df()
    except duckdb.Error as e:
        pytest.fail(str(e))
    got = registry.QUERIES[name](spark, DATA).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    assert sorted(map(str, got[cols].astype(str).values.tolist())) == sorted(map(str, want[cols].astype(str).values.tolist()))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", ["a01_union_to_vertices", "a03_vertex_up", "a09_bridge_layers", "r11_text", "t07_tags_on_entities"])
def test_whole_mesh(spark, name):
    test_query_equals_sql(spark, f"{name}_all")
    if name != "r11_text":  # all handles are fewer runs than a part of them
        assert registry.QUERIES[f"{name}_all"](spark, DATA).count() > registry.QUERIES[name](spark, DATA).count()


def test_entry_needs_no_session():
    import subprocess
    import sys

    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"], cwd=here, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
