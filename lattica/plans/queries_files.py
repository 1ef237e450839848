"""Registered queries: round trips through files and the native store."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from ..operators.fixpoint import store as _store
from ..sources import files, store
from . import tables as t

QUERIES, ORACLE = {}, {}


def _folder(spark) -> str:
    """A new folder beside the stored rounds."""
    _store(spark, spark.range(1))  # names the shared folder where none is set
    base = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.gettempdir()
    from pyarrow import fs

    uri = f"{base.rstrip('/')}/files-{uuid.uuid4().hex}"
    where, path = fs.FileSystem.from_uri(uri)
    where.create_dir(path, recursive=True)
    return uri


def add(name, run, sql):
    QUERIES[name] = run
    ORACLE[name] = sql


def _back(mesh):
    inc = mesh.incidence().join(mesh.vertices.withColumnRenamed("handle", "vertex"), "vertex")
    return inc.select("elem", F.col("pos").cast("long"), "x", "y", "z")


def _trip(save, suffix, mesh):
    def run(s, d):
        uri = f"{_folder(s)}/mesh.{suffix}"
        save(mesh(s), uri)
        return _back(files.load(s, uri))

    return run


INC = "SELECT e.handle AS elem, p - 1 AS pos, x, y, z FROM (SELECT handle, unnest(conn) AS c, unnest(range(1, len(conn) + 1)) AS p FROM {cells}) e JOIN {points} v ON v.handle = c"
add("f02_vtk_round_trip", _trip(files.save_vtk, "vtk", lambda s: t.hex_mesh(s, 4, True)), f"WITH {t.hex_sql(4, True)} " + INC.format(cells="bh", points="bv"))
add("f05_gmsh_round_trip", _trip(files.save_gmsh, "msh", lambda s: t.tet_mesh(s, 3, True)), f"WITH {t.tet_sql(3, True)} " + INC.format(cells="bt", points="bv"))
add("f06_smf_round_trip", _trip(files.save_smf, "smf", lambda s: t.quad_mesh(s, 8, True)), f"WITH {t.quad_sql(8, True)} " + INC.format(cells="qh", points="qv"))
add("f03_stl_round_trip", _trip(files.save_stl, "stl", lambda s: t.tri_mesh(s, 8, True)), f"WITH {t.tri_sql(8, True)} " + INC.format(cells="qt", points="qv"))


def _stored(s, d):
    folder = _folder(s)
    store.save(t.orders_mesh(s, d), folder)
    return store.load(s, folder)


add("f01_native_store", lambda s, d: _stored(s, d).elements.select("handle", F.concat_ws(",", F.transform("conn", lambda v: v.cast("string"))).alias("conn")), t.ORDERS_SQL + "SELECT handle, array_to_string(conn, ',') AS conn FROM elem")
add("f21_subset_load", lambda s, d: _subset(s, d), t.ORDERS_SQL + f", rec AS (SELECT {t.SET + t.REGION + 1} AS s UNION ALL SELECT entity FROM rec JOIN members ON \"set\" = s WHERE entity >= {t.SET}) SELECT DISTINCT entity AS handle FROM members JOIN rec ON \"set\" = s WHERE entity < {t.SET}")


def _subset(s, d):
    from ..model import Tag

    m = t.orders_mesh(s, d)
    tag = Tag("REGION", "long", m.sets.filter(F.col("handle").between(t.SET + t.REGION, t.SET + t.REGION + 4)).select(F.col("handle").alias("entity"), (F.col("handle") - t.SET - t.REGION).alias("value")))
    return store.load_subset(m.with_(tags=m.tags | {"REGION": tag}), {"REGION": [1]}).elements.select("handle")
