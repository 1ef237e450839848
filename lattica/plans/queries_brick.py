"""Registered queries on a brick as large as the tables: ten hexahedra for each customer, about.

They follow the brick procedure: create, vertex to hexahedra, hexahedra to
vertices with a centroid each, and the skin.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import model
from ..operators import adjacency as adj
from ..operators import measures, skinning
from . import tables as t

QUERIES, ORACLE = {}, {}


def add(name, run, sql):
    QUERIES[name] = run
    ORACLE[name] = sql


def cells(s, d) -> int:
    """Intervals a side: the cube root of ten times the customers (a count of the table's own statistics)."""
    n = t.table(s, d, "customer").count()
    return max(2, round((10 * n) ** (1 / 3)))


def brick(s, d):
    return t.hex_mesh(s, cells(s, d))


_RING = [(0, 0), (1, 0), (1, 1), (0, 1)]
_CONN = ", ".join(f"1 + i + {a} + m*(j + {b}) + m*m*(k + {c})" for c in (0, 1) for a, b in _RING)
SQL = f"""WITH n AS (SELECT greatest(2, round(pow(10 * count(*), 1.0/3)))::BIGINT AS n, n + 1 AS m FROM customer),
bv AS (SELECT 1 + i + m*j + m*m*k AS handle, i, j, k, n FROM n, (SELECT unnest(range(m)) AS i FROM n), (SELECT unnest(range(m)) AS j FROM n), (SELECT unnest(range(m)) AS k FROM n)),
bh AS (SELECT ({model.HEX}::BIGINT << 56) | (1 + i + n*j + n*n*k)::BIGINT AS handle, [{_CONN}]::BIGINT[] AS conn, i, j, k, n FROM n, (SELECT unnest(range(n)) AS i FROM n), (SELECT unnest(range(n)) AS j FROM n), (SELECT unnest(range(n)) AS k FROM n))"""
add("k11_brick", lambda s, d: brick(s, d).elements.select("handle", F.array_join("conn", ",").alias("conn")), f"{SQL} SELECT handle, array_to_string(conn, ',') AS conn FROM bh")
add("a03_brick_vertex_to_hex", lambda s, d: adj.pairs(m := brick(s, d), m.vertices.select("handle"), 3).groupBy("source").agg(F.count("*").alias("n"), F.min("target").alias("first")), f"{SQL} SELECT v AS source, count(*) AS n, min(handle) AS first FROM (SELECT handle, unnest(conn) AS v FROM bh) GROUP BY 1")
add("g09_brick_centroids", lambda s, d: measures.centroids(brick(s, d), 3), f"{SQL} SELECT handle, i + 0.5::DOUBLE AS x, j + 0.5::DOUBLE AS y, k + 0.5::DOUBLE AS z FROM bh")
add("k01_brick_skin", lambda s, d: skinning.skin_facets(brick(s, d), 3).groupBy("elem").agg(F.count("*").alias("n")), f"{SQL} SELECT handle AS elem, (i = 0)::BIGINT + (i = n - 1)::BIGINT + (j = 0)::BIGINT + (j = n - 1)::BIGINT + (k = 0)::BIGINT + (k = n - 1)::BIGINT AS n FROM bh WHERE i IN (0, n - 1) OR j IN (0, n - 1) OR k IN (0, n - 1)")
add("a10_brick_neighbours", lambda s, d: adj.neighbours(brick(s, d), 3).groupBy("elem").agg(F.count("*").alias("n")), f"{SQL} SELECT handle AS elem, 6 - ((i = 0)::BIGINT + (i = n - 1)::BIGINT + (j = 0)::BIGINT + (j = n - 1)::BIGINT + (k = 0)::BIGINT + (k = n - 1)::BIGINT) AS n FROM bh")
