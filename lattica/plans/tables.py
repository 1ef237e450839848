"""The star-schema tables read as a mesh, in Spark and in SQL.

Parts are vertices, orders of two or more distinct parts are elements by their
number of parts, regions, nations and customers are nested sets, suppliers are
lists. Boxes, triangle and tetrahedron grids are generated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..functions import numbering
from ..model import Mesh, Tag
from ..operators.structured import Box

SET = model.ENTITYSET << model.SHIFT
REGION, NATION, CUSTOMER, SUPPLIER, SEGMENT = 1, 100, 1000, 10_000_000, 20_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_mesh(spark: SparkSession, sf_dir: str) -> Mesh:
    t = lambda n: table(spark, sf_dir, n)
    part, line = t("part"), t("lineitem")
    rows = line.count()  # of the table's own statistics
    line = model.dealt(line, rows, "l_orderkey")
    vertices = part.select((F.col("p_partkey") + 1).alias("handle"), F.col("p_size").cast("double").alias("x"), (F.col("p_partkey") % 97).cast("double").alias("y"), (F.col("p_partkey") % 89).cast("double").alias("z"))
    once = line.groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("ln"))
    conn = F.transform(F.array_sort(F.collect_list(F.struct("ln", (F.col("l_partkey") + 1).alias("v")))), lambda s: s["v"])
    grouped = once.groupBy("l_orderkey").agg(conn.alias("conn")).filter(F.size("conn") >= 2)
    etype = F.when(F.size("conn") == 2, model.EDGE).when(F.size("conn") == 3, model.TRI).when(F.size("conn") == 4, model.QUAD).otherwise(model.POLYGON)
    keyed = grouped.withColumn("etype", etype).select("l_orderkey", model.handle(F.col("etype"), F.col("l_orderkey") + 1).alias("handle"), "etype", "conn")
    elements = keyed.drop("l_orderkey")
    region, nation, customer, supplier = t("region"), t("nation"), t("customer"), t("supplier")
    number = lambda base, c: (F.lit(SET + base) + F.col(c)).cast("long")
    unordered = F.lit(model.SET_LIKE | model.TRACK_OWNER)
    sets = region.select(number(REGION, "r_regionkey").alias("handle"), unordered.alias("flags"))
    sets = sets.union(nation.select(number(NATION, "n_nationkey"), unordered)).union(customer.select(number(CUSTOMER, "c_custkey"), unordered)).union(supplier.select(number(SUPPLIER, "s_suppkey"), F.lit(model.ORDERED)))
    of_orders = model.dealt(t("orders"), rows, "o_orderkey").join(keyed.select("handle", F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")
    pos = F.lit(0).cast("long").alias("pos")
    links = nation.select(number(REGION, "n_regionkey").alias("parent"), number(NATION, "n_nationkey").alias("child"))
    links = links.union(customer.select(number(NATION, "c_nationkey"), number(CUSTOMER, "c_custkey")))
    members = links.select(F.col("parent").alias("set"), pos, F.col("child").alias("entity"))
    members = members.union(of_orders.select(number(CUSTOMER, "o_custkey"), pos, F.col("handle")))
    listed = line.select("l_suppkey", "l_orderkey").join(keyed.select("handle", "l_orderkey"), "l_orderkey")
    rank = F.row_number().over(_by_supplier())
    members = members.union(listed.select(number(SUPPLIER, "l_suppkey").alias("set"), (rank - 1).cast("long").alias("pos"), F.col("handle").alias("entity")))
    cents = of_orders.select(F.col("handle").alias("entity"), F.round(F.col("o_totalprice") * 100).cast("long").alias("value"))
    urgent = of_orders.filter("o_orderpriority = '1-URGENT'").select(F.col("handle").alias("entity"), F.col("o_orderpriority").alias("value"))
    retail = part.select((F.col("p_partkey") + 1).alias("entity"), F.round(F.col("p_retailprice") * 100).cast("long").alias("value"))
    tags = {x.name: x for x in (Tag("PRICE", "long", cents, storage="dense"), Tag("PRIORITY", "string", urgent, "5-LOW"), Tag("RETAIL", "long", retail, storage="dense"))}
    return Mesh(vertices, elements, sets, members, links.withColumn("pos", F.lit(0)), None, tags, rows=rows)


def _by_supplier():
    from pyspark.sql import Window

    return Window.partitionBy("l_suppkey").orderBy("l_orderkey", "handle")


#: The same mesh for DuckDB.
ORDERS_SQL = f"""WITH RECURSIVE inc0 AS (SELECT l_orderkey o, l_partkey p, min(l_linenumber) ln FROM lineitem GROUP BY 1, 2),
inc1 AS (SELECT o, p, row_number() OVER (PARTITION BY o ORDER BY ln, p) - 1 AS pos, count(*) OVER (PARTITION BY o) AS n FROM inc0),
inc AS (SELECT ((CASE WHEN n = 2 THEN 1 WHEN n = 3 THEN 2 WHEN n = 4 THEN 3 ELSE 4 END)::BIGINT << 56) | (o + 1)::BIGINT AS elem, pos, (p + 1)::BIGINT AS vertex, o FROM inc1 WHERE n >= 2),
vtx AS (SELECT (p_partkey + 1)::BIGINT AS handle, p_size::DOUBLE AS x, (p_partkey % 97)::DOUBLE AS y, (p_partkey % 89)::DOUBLE AS z FROM part),
elem AS (SELECT elem AS handle, (elem >> 56)::INTEGER AS etype, o, list(vertex ORDER BY pos) AS conn FROM inc GROUP BY 1, 2, 3),
eo AS (SELECT e.handle, o.* FROM elem e JOIN orders o ON o.o_orderkey = e.o),
lnk AS (SELECT {SET + REGION} + n_regionkey::BIGINT AS parent, {SET + NATION} + n_nationkey::BIGINT AS child FROM nation
  UNION ALL SELECT {SET + NATION} + c_nationkey::BIGINT, {SET + CUSTOMER} + c_custkey::BIGINT FROM customer),
sets AS (SELECT {SET + REGION} + r_regionkey::BIGINT AS handle, 3 AS flags FROM region UNION ALL SELECT {SET + NATION} + n_nationkey::BIGINT, 3 FROM nation
  UNION ALL SELECT {SET + CUSTOMER} + c_custkey::BIGINT, 3 FROM customer UNION ALL SELECT {SET + SUPPLIER} + s_suppkey::BIGINT, 4 FROM supplier),
members AS (SELECT parent AS "set", 0::BIGINT AS pos, child AS entity FROM lnk UNION ALL SELECT {SET + CUSTOMER} + o_custkey::BIGINT, 0, handle FROM eo
  UNION ALL SELECT {SET + SUPPLIER} + l_suppkey::BIGINT, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, handle) - 1, handle FROM lineitem JOIN elem ON l_orderkey = o)
"""

SUB_SQL = "sub(etype, subdim, side, sub_etype, local) AS (VALUES " + ", ".join(f"({a}, {b}, {c}, {d}, {list(e)})" for a, b, c, d, e in numbering.rows()) + ")"


def box(n: int) -> Box:
    return Box((0, 0, 0), (n, n, n))


def hex_mesh(spark: SparkSession, n: int, skewed: bool = False) -> Mesh:
    """A cube of ``n`` cubed hexahedra; skewed by whole thirds and fifths if asked."""
    coords = (F.col("i") * 4 + (F.col("j") * F.col("k")) % 3, F.col("j") * 4 + F.col("i") % 2, F.col("k") * 4 + (F.col("i") + F.col("j")) % 2) if skewed else None
    return box(n).mesh(spark, coords)


def hex_sql(n: int, skewed: bool = False) -> str:
    """``bv(handle, i, j, k, x, y, z)`` and ``bh(handle, etype, conn, i, j, k)`` as CTE bodies."""
    m = n + 1
    x, y, z = ("i*4 + (j*k)%3", "j*4 + i%2", "k*4 + (i+j)%2") if skewed else ("i", "j", "k")
    v = lambda a, b, c: f"1 + i + {a} + {m}*(j + {b}) + {m * m}*(k + {c})"
    ring = [(0, 0), (1, 0), (1, 1), (0, 1)]
    conn = ", ".join(v(a, b, c) for c in (0, 1) for a, b in ring)
    return f"""bv AS (SELECT (1 + i + {m}*j + {m * m}*k)::BIGINT AS handle, i, j, k, ({x})::DOUBLE AS x, ({y})::DOUBLE AS y, ({z})::DOUBLE AS z FROM range({m}) a(i), range({m}) b(j), range({m}) c(k)),
bh AS (SELECT ((9::BIGINT << 56) | (1 + i + {n}*j + {n * n}*k)::BIGINT) AS handle, 9 AS etype, [{conn}]::BIGINT[] AS conn, i, j, k FROM range({n}) a(i), range({n}) b(j), range({n}) c(k))"""


def quad_mesh(spark: SparkSession, n: int, bumpy: bool = False) -> Mesh:
    """A flat grid of quads, raised in places if asked."""
    b = Box((0, 0, 0), (n, n, 0))
    return b.mesh(spark, (F.col("i") * 3, F.col("j") * 3, (F.col("i") * F.col("j")) % 4) if bumpy else None)


def quad_sql(n: int, bumpy: bool = False) -> str:
    m = n + 1
    x, y, z = ("i*3", "j*3", "(i*j)%4") if bumpy else ("i", "j", "0")
    v = lambda a, b: f"1 + i + {a} + {m}*(j + {b})"
    conn = ", ".join(v(a, b) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1)))
    return f"""qv AS (SELECT (1 + i + {m}*j)::BIGINT AS handle, i, j, ({x})::DOUBLE AS x, ({y})::DOUBLE AS y, ({z})::DOUBLE AS z FROM range({m}) a(i), range({m}) b(j)),
qh AS (SELECT ((3::BIGINT << 56) | (1 + i + {n}*j)::BIGINT) AS handle, 3 AS etype, [{conn}]::BIGINT[] AS conn, i, j FROM range({n}) a(i), range({n}) b(j))"""


# Six tetrahedra of a hexahedron around its diagonal from corner 0 to corner 6.
SIX_TETS = ((0, 1, 2, 6), (0, 2, 3, 6), (0, 3, 7, 6), (0, 7, 4, 6), (0, 4, 5, 6), (0, 5, 1, 6))


def tet_mesh(spark: SparkSession, n: int, skewed: bool = False) -> Mesh:
    """The cube's hexahedra cut into six tetrahedra each."""
    h = hex_mesh(spark, n, skewed)
    kids = F.array(*(F.struct(F.lit(i).alias("i"), F.array(*(F.element_at("conn", v + 1) for v in t)).alias("conn")) for i, t in enumerate(SIX_TETS)))
    rows = h.elements.select("handle", F.explode(kids).alias("k"))
    return h.with_(elements=rows.select(model.handle(model.TET, (model.id_of(F.col("handle")) - 1) * 6 + F.col("k.i") + 1).alias("handle"), F.lit(model.TET).alias("etype"), F.col("k.conn").alias("conn")))


def tet_sql(n: int, skewed: bool = False) -> str:
    rows = " UNION ALL ".join(f"SELECT ((5::BIGINT << 56) | (((handle & {model.ID_MASK}) - 1) * 6 + {i + 1})) AS handle, 5 AS etype, [{', '.join(f'conn[{v + 1}]' for v in t)}] AS conn FROM bh" for i, t in enumerate(SIX_TETS))
    return f"{hex_sql(n, skewed)}, bt AS ({rows})"


def tri_mesh(spark: SparkSession, n: int, bumpy: bool = False) -> Mesh:
    """The grid's quads cut into two triangles each."""
    q = quad_mesh(spark, n, bumpy)
    kids = F.array(*(F.struct(F.lit(i).alias("i"), F.array(*(F.element_at("conn", v + 1) for v in t)).alias("conn")) for i, t in enumerate(((0, 1, 2), (0, 2, 3)))))
    rows = q.elements.select("handle", F.explode(kids).alias("k"))
    return q.with_(elements=rows.select(model.handle(model.TRI, (model.id_of(F.col("handle")) - 1) * 2 + F.col("k.i") + 1).alias("handle"), F.lit(model.TRI).alias("etype"), F.col("k.conn").alias("conn")))


def tri_sql(n: int, bumpy: bool = False) -> str:
    rows = " UNION ALL ".join(f"SELECT ((2::BIGINT << 56) | (((handle & {model.ID_MASK}) - 1) * 2 + {i + 1})) AS handle, 2 AS etype, [{', '.join(f'conn[{v + 1}]' for v in t)}] AS conn FROM qh" for i, t in enumerate(((0, 1, 2), (0, 2, 3))))
    return f"{quad_sql(n, bumpy)}, qt AS ({rows})"


def points(spark: SparkSession, sf_dir: str, scale: float, shift: float) -> DataFrame:
    """``(pid, x, y, z)`` from the first three numbers of each embedding, moved into a box."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("long").alias("pid"), *((F.element_at("embedding", i + 1).cast("double") * scale + shift).alias(c) for i, c in enumerate("xyz")))


def points_sql(scale: float, shift: float) -> str:
    return "pts AS (SELECT vec_id::BIGINT AS pid, " + ", ".join(f"embedding[{i + 1}]::DOUBLE * {scale} + {shift} AS {c}" for i, c in enumerate("xyz")) + " FROM embeddings)"
