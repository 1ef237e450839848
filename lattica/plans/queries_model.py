"""Registered queries: selection, handle lists, sets, tags (each with its DuckDB equivalent)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import model
from ..operators import entities, fields, mutation, ranges, sets, tags
from ..operators import adjacency as adj
from .tables import CUSTOMER, NATION, ORDERS_SQL, REGION, SET, SUPPLIER, orders_mesh, table

QUERIES, ORACLE = {}, {}


def H():
    return F.col("handle")




def add(name, run, sql=None):
    QUERIES[name] = run
    if sql:
        ORACLE[name] = sql


def on_orders(name, run, sql):
    """A query on the orders mesh; ``sql`` follows the mesh's common tables."""
    add(name, lambda s, d: run(orders_mesh(s, d)), ORDERS_SQL + sql)


def handles_of(mesh, cond):
    return mesh.elements.filter(cond).select("handle")


# selection -----------------------------------------------------------------------
on_orders("q01_by_dimension", lambda m: entities.by_dimension(m, 2), "SELECT handle FROM elem WHERE etype IN (2, 3, 4)")
on_orders("q01_by_dimension_in_set", lambda m: entities.by_dimension(m, 1, SET + REGION + 1, True), f", RECURSE AS (SELECT {SET + REGION + 1} AS s UNION ALL SELECT entity FROM RECURSE JOIN members ON \"set\" = s WHERE entity >= {SET}) SELECT DISTINCT entity AS handle FROM members JOIN RECURSE ON \"set\" = s WHERE (entity >> 56) = 1".replace("RECURSE", "rec"))
on_orders("q02_by_type", lambda m: entities.by_type(m, model.QUAD), "SELECT handle FROM elem WHERE etype = 3")
on_orders("q02_sets_in_set", lambda m: entities.by_type(m, model.ENTITYSET, SET + REGION, True), f", rec AS (SELECT {SET + REGION} AS s UNION ALL SELECT entity FROM rec JOIN members ON \"set\" = s WHERE entity >= {SET}) SELECT DISTINCT s AS handle FROM rec WHERE s <> {SET + REGION}")
on_orders("q03_by_handle", lambda m: entities.by_handle(m), "SELECT handle FROM vtx UNION ALL SELECT handle FROM elem UNION ALL SELECT handle FROM sets")
on_orders("q03_list_order", lambda m: entities.ordered_members(m, SET + SUPPLIER + 1), f"SELECT row_number() OVER (ORDER BY pos) - 1 AS pos, entity AS handle FROM members WHERE \"set\" = {SET + SUPPLIER + 1}")
on_orders("q03_by_handle_recursive", lambda m: entities.by_handle(m, SET + REGION + 2, True), f", rec AS (SELECT {SET + REGION + 2} AS s UNION ALL SELECT entity FROM rec JOIN members ON \"set\" = s WHERE entity >= {SET}) SELECT DISTINCT entity AS handle FROM members JOIN rec ON \"set\" = s WHERE entity < {SET}")
on_orders("q04_tag_default", lambda m: entities.by_type_and_tag(m, model.TRI, ["PRIORITY"], ["5-LOW"]), "SELECT handle FROM eo WHERE (handle >> 56) = 2 AND o_orderpriority <> '1-URGENT'")
on_orders("q04_tag_value", lambda m: entities.by_type_and_tag(m, model.TRI, ["PRIORITY"], ["1-URGENT"]), "SELECT handle FROM eo WHERE (handle >> 56) = 2 AND o_orderpriority = '1-URGENT'")
on_orders("q04_tags_intersect", lambda m: entities.by_type_and_tag(m, model.QUAD, ["PRIORITY", "PRICE"], [None, None]), "SELECT handle FROM eo WHERE (handle >> 56) = 3 AND o_orderpriority = '1-URGENT'")
on_orders("q04_tags_union", lambda m: entities.by_type_and_tag(m, model.EDGE, ["PRIORITY", "PRICE"], ["1-URGENT", None], "union"), "SELECT handle FROM eo WHERE (handle >> 56) = 1")
on_orders("q05_numbers", lambda m: entities.number(m).select(F.col("dim").cast("long"), F.col("etype").cast("long"), "n"), "SELECT (CASE WHEN t = 0 THEN 0 WHEN t = 1 THEN 1 WHEN t < 5 THEN 2 WHEN t < 11 THEN 3 ELSE 4 END)::BIGINT AS dim, t AS etype, count(*) AS n FROM (SELECT handle >> 56 AS t FROM vtx UNION ALL SELECT handle >> 56 FROM elem UNION ALL SELECT handle >> 56 FROM sets) GROUP BY t")
on_orders("q05_number_in_list", lambda m: entities.number(m, SET + SUPPLIER + 2).select(F.col("etype").cast("long"), "n"), f"SELECT entity >> 56 AS etype, count(*) AS n FROM members WHERE \"set\" = {SET + SUPPLIER + 2} GROUP BY 1")
on_orders("q06_decode", lambda m: entities.decoded(m.handles()).select("handle", F.col("etype").cast("long"), "id", F.col("dim").cast("long"), "type"), "SELECT handle, handle >> 56 AS etype, handle & 72057594037927935 AS id, (CASE WHEN t = 0 THEN 0 WHEN t = 1 THEN 1 WHEN t < 5 THEN 2 WHEN t < 11 THEN 3 ELSE 4 END)::BIGINT AS dim, ['VERTEX','EDGE','TRI','QUAD','POLYGON','TET','PYRAMID','PRISM','KNIFE','HEX','POLYHEDRON','ENTITYSET'][t + 1] AS type FROM (SELECT handle, handle >> 56 AS t FROM (SELECT handle FROM vtx UNION ALL SELECT handle FROM elem UNION ALL SELECT handle FROM sets))")
on_orders("q07_coords", lambda m: _rounded(entities.coordinates(m, m.handles().filter(H() < SET))), "SELECT handle, floor(x*1e6+0.5)::BIGINT AS x, floor(y*1e6+0.5)::BIGINT AS y, floor(z*1e6+0.5)::BIGINT AS z FROM (SELECT handle, x, y, z FROM vtx UNION ALL SELECT elem, avg(x), avg(y), avg(z) FROM inc JOIN vtx ON vertex = handle GROUP BY elem)")
on_orders("q08_vertex_coordinates", lambda m: m.vertices, "SELECT handle, x, y, z FROM vtx")
on_orders("q09_connectivity", lambda m: entities.connectivity(m, handles_of(m, "etype = 3"), True).select("handle", F.col("pos").cast("long"), "vertex"), "SELECT elem AS handle, pos, vertex FROM inc WHERE (elem >> 56) = 3")
on_orders("q10_connectivity_range", lambda m: entities.connectivity_vertices(m, handles_of(m, "etype = 2")), "SELECT DISTINCT vertex AS handle FROM inc WHERE (elem >> 56) = 2")
on_orders("q11_set_pages", lambda m: entities.pages(handles_of(m, "etype = 2"), 64), "SELECT (row_number() OVER (ORDER BY handle) - 1) // 64 AS chunk, handle FROM elem WHERE etype = 2")
on_orders("q13_listing", lambda m: entities.listing(m), "SELECT ['VERTEX','EDGE','TRI','QUAD','POLYGON'][etype + 1] || ' ' || (handle & 72057594037927935) AS entity, array_to_string(conn, ',') AS vertices FROM elem")
on_orders("q14_memory", lambda m: entities.memory_use(m), "SELECT 'vertices' AS relation, count(*) * 32 AS bytes FROM vtx UNION ALL SELECT 'elements', sum(8 + 8 * len(conn))::BIGINT FROM elem")
on_orders("q15_dangling", lambda m: entities.dangling(m).select("elem", F.col("pos").cast("long"), "vertex"), "SELECT elem, pos, vertex FROM inc WHERE vertex NOT IN (SELECT handle FROM vtx)")
on_orders("q16_dimension", lambda m: m.elements.agg(F.max(model.dimension_of(H())).cast("long").alias("dim")), "SELECT 2::BIGINT AS dim")


def _rounded(df, *names):
    return df.select("handle", *(F.floor(F.col(c) * 1e6 + 0.5).cast("long").alias(c) for c in (names or "xyz")))


# handle lists --------------------------------------------------------------------
_A, _B = "handle % 3 = 0", "handle % 4 < 2"
two = lambda m: (handles_of(m, _A), handles_of(m, _B))
on_orders("r01_intersect", lambda m: ranges.intersect(*two(m)), f"SELECT handle FROM elem WHERE {_A} AND {_B}")
on_orders("r02_subtract", lambda m: ranges.subtract(*two(m)), f"SELECT handle FROM elem WHERE {_A} AND NOT {_B}")
on_orders("r03_unite", lambda m: ranges.unite(*two(m)), f"SELECT handle FROM elem WHERE {_A} OR {_B}")
on_orders("r04_pop", lambda m: ranges.pop_back(ranges.pop_front(handles_of(m, _A))), f"SELECT handle FROM elem WHERE {_A} AND handle NOT IN (SELECT min(handle) FROM elem WHERE {_A} UNION ALL SELECT max(handle) FROM elem WHERE {_A})")
on_orders("r05_bounds", lambda m: ranges.lower_bound(handles_of(m, _A), 2 << 56).unionByName(ranges.upper_bound(handles_of(m, _A), (3 << 56) | 7)), f"SELECT min(handle) AS handle FROM elem WHERE {_A} AND handle >= {2 << 56} UNION ALL SELECT min(handle) FROM elem WHERE {_A} AND handle > {(3 << 56) | 7}")
on_orders("r06_subset", lambda m: ranges.by_type(handles_of(m, _A), model.TRI), f"SELECT handle FROM elem WHERE {_A} AND etype = 2")
on_orders("r06_subset_dimension", lambda m: ranges.by_dimension(m.handles(), 2), "SELECT handle FROM elem WHERE etype IN (2, 3, 4)")
on_orders("r07_counts", lambda m: ranges.counts(handles_of(m, _A)).select(F.col("etype").cast("long"), F.col("dim").cast("long"), "n"), f"SELECT etype::BIGINT AS etype, (CASE WHEN etype = 1 THEN 1 ELSE 2 END)::BIGINT AS dim, count(*) AS n FROM elem WHERE {_A} GROUP BY 1, 2")
on_orders("r07_all_of_type", lambda m: ranges.all_of_type(handles_of(m, "etype = 2"), model.TRI), "SELECT true AS all_of_type")
on_orders("r08_contains", lambda m: ranges.contains(m.elements.select("handle"), handles_of(m, _A)), "SELECT true AS contains")
on_orders("r09_index", lambda m: ranges.index(handles_of(m, _B)), f"SELECT handle, row_number() OVER (ORDER BY handle) - 1 AS \"index\" FROM elem WHERE {_B}")
_ISL = f"SELECT min(handle) AS first, max(handle) AS last, count(*) AS size FROM (SELECT handle, handle - row_number() OVER (ORDER BY handle) AS g FROM elem WHERE {_B}) GROUP BY g"
on_orders("r10_intervals", lambda m: ranges.intervals(handles_of(m, _B)), _ISL)
on_orders("r10_compactness", lambda m: ranges.compactness(handles_of(m, _B)).select("size", "psize"), f"SELECT sum(size)::BIGINT AS size, count(*) AS psize FROM ({_ISL})")
on_orders("r11_text", lambda m: ranges.describe(handles_of(m, "handle % 50 < 3")), f"SELECT ['VERTEX','EDGE','TRI','QUAD','POLYGON'][t + 1] AS type, string_agg(s, ',' ORDER BY f) AS runs FROM (SELECT (min(handle) >> 56) AS t, min(handle) AS f, CASE WHEN min(handle) = max(handle) THEN (min(handle) & {model.ID_MASK})::VARCHAR ELSE (min(handle) & {model.ID_MASK}) || '-' || (max(handle) & {model.ID_MASK}) END AS s FROM (SELECT handle, handle - row_number() OVER (ORDER BY handle) AS g FROM elem WHERE handle % 50 < 3) GROUP BY g) GROUP BY t")
on_orders("r11_text_all", lambda m: ranges.describe(m.elements.select("handle")), f"SELECT ['VERTEX','EDGE','TRI','QUAD','POLYGON'][t + 1] AS type, string_agg(s, ',' ORDER BY f) AS runs FROM (SELECT (min(handle) >> 56) AS t, min(handle) AS f, CASE WHEN min(handle) = max(handle) THEN (min(handle) & {model.ID_MASK})::VARCHAR ELSE (min(handle) & {model.ID_MASK}) || '-' || (max(handle) & {model.ID_MASK}) END AS s FROM (SELECT handle, handle - row_number() OVER (ORDER BY handle) AS g FROM elem) GROUP BY g) GROUP BY t")
on_orders("r12_interval_map", lambda m: ranges.interval_lookup(m.vertices.select("handle"), m.spark.createDataFrame([(1, 40, 500), (60, 1400, 9000)], "first long, last long, start long")), "SELECT handle, 500 + handle - 1 AS value FROM vtx WHERE handle BETWEEN 1 AND 40 UNION ALL SELECT handle, 9000 + handle - 60 FROM vtx WHERE handle BETWEEN 60 AND 1400")

# sets ------------------------------------------------------------------------------
contents = lambda m, s: m.members.filter(F.col("set") == s).select("entity")
on_orders("s01_set_options", lambda m: contents(sets.set_options(m, SET + SUPPLIER + 3, model.SET_LIKE), SET + SUPPLIER + 3), f"SELECT DISTINCT entity FROM members WHERE \"set\" = {SET + SUPPLIER + 3}")
on_orders("s02_add_list", lambda m: contents(sets.add(m, SET + SUPPLIER + 3, handles_of(m, "handle % 97 = 5")), SET + SUPPLIER + 3), f"SELECT entity FROM members WHERE \"set\" = {SET + SUPPLIER + 3} UNION ALL SELECT handle FROM elem WHERE handle % 97 = 5")
on_orders("s02_add_set", lambda m: contents(sets.add(m, SET + CUSTOMER + 7, handles_of(m, "handle % 97 = 5")), SET + CUSTOMER + 7), f"SELECT entity FROM members WHERE \"set\" = {SET + CUSTOMER + 7} UNION SELECT handle FROM elem WHERE handle % 97 = 5")
on_orders("s02_remove_list", lambda m: contents(sets.remove(m, SET + SUPPLIER + 3, handles_of(m, "handle % 2 = 0")), SET + SUPPLIER + 3), f"SELECT entity FROM (SELECT entity, row_number() OVER (PARTITION BY entity ORDER BY pos DESC) AS n FROM members WHERE \"set\" = {SET + SUPPLIER + 3}) WHERE entity % 2 <> 0 OR n > 1")
on_orders("s02_remove_set", lambda m: contents(sets.remove(m, SET + CUSTOMER + 7, handles_of(m, "handle % 2 = 0")), SET + CUSTOMER + 7), f"SELECT entity FROM members WHERE \"set\" = {SET + CUSTOMER + 7} AND entity % 2 <> 0")
on_orders("s03_clear", lambda m: sets.clear(m, SET + SUPPLIER + 3).members.groupBy("set").agg(F.count("*").alias("n")), f"SELECT \"set\", count(*) AS n FROM members WHERE \"set\" <> {SET + SUPPLIER + 3} GROUP BY 1")
on_orders("s04_unite", lambda m: contents(sets.unite(m, SET + CUSTOMER + 7, SET + CUSTOMER + 10), SET + CUSTOMER + 7), f"SELECT DISTINCT entity FROM members WHERE \"set\" IN ({SET + CUSTOMER + 7}, {SET + CUSTOMER + 10})")
on_orders("s05_intersect", lambda m: contents(sets.intersect(m, SET + SUPPLIER + 3, SET + SUPPLIER + 4), SET + SUPPLIER + 3), f"SELECT entity FROM members WHERE \"set\" = {SET + SUPPLIER + 3} AND entity IN (SELECT entity FROM members WHERE \"set\" = {SET + SUPPLIER + 4})")
on_orders("s06_subtract", lambda m: contents(sets.subtract(m, SET + SUPPLIER + 3, SET + SUPPLIER + 4), SET + SUPPLIER + 3), f"SELECT entity FROM members WHERE \"set\" = {SET + SUPPLIER + 3} AND entity NOT IN (SELECT entity FROM members WHERE \"set\" = {SET + SUPPLIER + 4})")
on_orders("s07_contains_any", lambda m: sets.contains(m, SET + SUPPLIER + 3, handles_of(m, "etype = 2"), "union"), f"SELECT count(*) > 0 AS contains FROM members WHERE \"set\" = {SET + SUPPLIER + 3} AND (entity >> 56) = 2")
on_orders("s07_contains_all", lambda m: sets.contains(m, SET + SUPPLIER + 3, handles_of(m, "etype = 2")), f"SELECT bool_and(handle IN (SELECT entity FROM members WHERE \"set\" = {SET + SUPPLIER + 3})) AS contains FROM elem WHERE etype = 2")
on_orders("s08_replace", lambda m: contents(sets.replace(m, SET + SUPPLIER + 3, handles_of(m, "handle % 5 = 0").select(H().alias("old"), F.lit(77).cast("long").alias("new"))), SET + SUPPLIER + 3), f"SELECT CASE WHEN entity % 5 = 0 THEN 77 ELSE entity END AS entity FROM members WHERE \"set\" = {SET + SUPPLIER + 3}")
on_orders("s09_recursive", lambda m: sets.contents(m, SET + REGION + 3, True).select("entity").distinct(), f", rec AS (SELECT {SET + REGION + 3} AS s UNION ALL SELECT entity FROM rec JOIN members ON \"set\" = s WHERE entity >= {SET}) SELECT DISTINCT entity FROM members JOIN rec ON \"set\" = s")
on_orders("s10_children_all", lambda m: sets.children(m, SET + REGION + 1, 0).select("handle", F.col("hop").cast("long")), f"SELECT child AS handle, 1::BIGINT AS hop FROM lnk WHERE parent = {SET + REGION + 1} UNION ALL SELECT b.child, 2 FROM lnk a JOIN lnk b ON b.parent = a.child WHERE a.parent = {SET + REGION + 1}")
on_orders("s10_parents", lambda m: sets.parents(m, SET + CUSTOMER + 7, 2).select("handle", F.col("hop").cast("long")), f"SELECT parent AS handle, 1::BIGINT AS hop FROM lnk WHERE child = {SET + CUSTOMER + 7} UNION ALL SELECT a.parent, 2 FROM lnk b JOIN lnk a ON b.parent = a.child WHERE b.child = {SET + CUSTOMER + 7}")
on_orders("s10_contained", lambda m: sets.contained(m, SET + REGION + 1, 1).select("handle"), f"SELECT entity AS handle FROM members WHERE \"set\" = {SET + REGION + 1} AND entity >= {SET}")
on_orders("s11_link_counts", lambda m: sets.link_counts(m), f"SELECT handle, (SELECT count(*) FROM lnk WHERE parent = handle) AS n_child, (SELECT count(*) FROM lnk WHERE child = handle) AS n_parent, (SELECT count(*) FROM members WHERE \"set\" = handle AND entity >= {SET}) AS n_contained FROM sets")
on_orders("s12_links", lambda m: sets.unlink(sets.link(m, SET + REGION, SET + CUSTOMER + 1), SET + NATION + 3, SET + CUSTOMER + 1).links.select("parent", "child"), f"SELECT parent, child FROM lnk WHERE NOT (parent = {SET + NATION + 3} AND child = {SET + CUSTOMER + 1}) UNION SELECT {SET + REGION}, {SET + CUSTOMER + 1}")

# tags -------------------------------------------------------------------------------
on_orders("t01_metadata", lambda m: tags.metadata(tags.get_handle(m, "LEVEL", "int", 3, "dense", frozenset({"creat"}), None)[0]).select("name", "dtype", F.col("length").cast("long"), "storage"), "SELECT * FROM (VALUES ('PRICE','long',1::BIGINT,'dense'), ('PRIORITY','string',1,'sparse'), ('RETAIL','long',1,'dense'), ('LEVEL','int',3,'dense')) t(name, dtype, length, storage)")
on_orders("t02_default_fallback", lambda m: tags.get_data(m, "PRIORITY", handles_of(m, "etype = 3")), "SELECT handle, CASE WHEN o_orderpriority = '1-URGENT' THEN '1-URGENT' ELSE '5-LOW' END AS value FROM eo WHERE (handle >> 56) = 3")
on_orders("t03_set_data", lambda m: tags.get_data(tags.set_data(m, "PRICE", handles_of(m, "handle % 7 = 0").select(H().alias("entity"), F.lit(1).cast("long").alias("value"))), "PRICE", handles_of(m, "etype = 2")), "SELECT handle, CASE WHEN handle % 7 = 0 THEN 1 ELSE round(o_totalprice * 100)::BIGINT END AS value FROM eo WHERE (handle >> 56) = 2")
on_orders("t04_clear_data", lambda m: tags.tagged(tags.clear_data(m, "PRIORITY", handles_of(m, "handle % 11 = 0"), "2-HIGH"), "PRIORITY"), "SELECT handle FROM eo WHERE o_orderpriority = '1-URGENT' OR handle % 11 = 0")
on_orders("t05_delete_data", lambda m: tags.tagged(tags.delete_data(m, "PRIORITY", handles_of(m, "handle % 2 = 0")), "PRIORITY"), "SELECT handle FROM eo WHERE o_orderpriority = '1-URGENT' AND handle % 2 <> 0")
on_orders("t06_variable_length", lambda m: m.elements.select("handle", F.size("conn").cast("long").alias("length")), "SELECT handle, len(conn) AS length FROM elem")
on_orders("t07_tags_on_entities", lambda m: tags.on_entities(m, handles_of(m, "handle % 5 = 0")), "SELECT handle, 'PRICE' AS tag FROM eo WHERE handle % 5 = 0 UNION ALL SELECT handle, 'PRIORITY' FROM eo WHERE handle % 5 = 0 AND o_orderpriority = '1-URGENT'")
on_orders("t07_tags_on_entities_all", lambda m: tags.on_entities(m, m.elements.select("handle")), "SELECT handle, 'PRICE' AS tag FROM eo UNION ALL SELECT handle, 'PRIORITY' FROM eo WHERE o_orderpriority = '1-URGENT'")
on_orders("t08_default_values", lambda m: tags.metadata(m).select("name", "default_value").filter("default_value IS NOT NULL"), "SELECT 'PRIORITY' AS name, '5-LOW' AS default_value")
on_orders("t09_tagged", lambda m: tags.tagged(m, "PRIORITY", model.EDGE), "SELECT handle FROM eo WHERE o_orderpriority = '1-URGENT' AND (handle >> 56) = 1")
on_orders("t10_with_value", lambda m: tags.with_value(m, "PRIORITY", "1-URGENT"), "SELECT handle FROM eo WHERE o_orderpriority = '1-URGENT'")
on_orders("t12_propagate", lambda m: tags.propagate(tags.set_data(tags.get_handle(m, "SEGMENT", "long", flags=frozenset({"creat"}))[0], "SEGMENT", m.sets.filter(F.col("flags") == 3).select(H().alias("entity"), (H() % 5).alias("value"))), "SEGMENT").filter(F.col("entity") < SET), f"SELECT handle AS entity, ({SET + CUSTOMER} + o_custkey) % 5 AS value FROM eo")

# adjacency on the orders mesh ----------------------------------------------------------
on_orders("a01_union_to_vertices", lambda m: adj.adjacencies(m, handles_of(m, "etype = 2 AND handle % 10 = 0"), 0), "SELECT DISTINCT vertex AS handle FROM inc WHERE (elem >> 56) = 2 AND elem % 10 = 0")
on_orders("a01_union_to_vertices_all", lambda m: adj.adjacencies(m, handles_of(m, "etype = 2"), 0), "SELECT DISTINCT vertex AS handle FROM inc WHERE (elem >> 56) = 2")
on_orders("a02_intersect", lambda m: adj.adjacencies(m, m.vertices.filter("handle IN (2, 9)").select("handle"), 2, "intersect"), "SELECT elem AS handle FROM inc WHERE (elem >> 56) IN (2, 3, 4) AND vertex IN (2, 9) GROUP BY elem HAVING count(*) = 2")
on_orders("a03_vertex_up", lambda m: adj.pairs(m, m.vertices.filter("handle < 200").select("handle"), 2), "SELECT vertex AS source, elem AS target FROM inc WHERE vertex < 200 AND (elem >> 56) IN (2, 3, 4)")
on_orders("a03_vertex_up_all", lambda m: adj.pairs(m, m.vertices.select("handle"), 2), "SELECT vertex AS source, elem AS target FROM inc WHERE (elem >> 56) IN (2, 3, 4)")
on_orders("a05_edge_up", lambda m: adj.upward(m, handles_of(m, "etype = 1"), 2), "SELECT a.elem AS source, b.elem AS target FROM inc a JOIN inc b ON a.vertex = b.vertex WHERE (a.elem >> 56) = 1 AND (b.elem >> 56) IN (2, 3, 4) GROUP BY 1, 2 HAVING count(*) = 2")
on_orders("a06_owning_sets", lambda m: adj.owners(m, handles_of(m, "etype = 1")), f"SELECT handle AS source, {SET + CUSTOMER} + o_custkey AS target FROM eo WHERE (handle >> 56) = 1")
on_orders("a08_explicit", lambda m: adj.add_explicit(m, m.members.filter((F.col("set") == SET + CUSTOMER + 7)).select(F.col("entity").alias("from"), F.lit(5).cast("long").alias("to"))).explicit, f"SELECT entity AS \"from\", 5::BIGINT AS \"to\" FROM members WHERE \"set\" = {SET + CUSTOMER + 7} UNION ALL SELECT 5, entity FROM members WHERE \"set\" = {SET + CUSTOMER + 7}")
on_orders("a13_equivalent", lambda m: adj.equivalent(m, 1), "SELECT handle, twin FROM (SELECT handle, min(handle) OVER (PARTITION BY list_sort(conn)) AS twin FROM elem WHERE etype = 1) WHERE handle <> twin")

# changes -----------------------------------------------------------------------------
on_orders("m01_create", lambda m: mutation.create_vertices(m, m.spark.createDataFrame([(1, 0.0, 1.0, 2.0), (2, 3.0, 4.0, 5.0)], "ord int, x double, y double, z double")).vertices, "SELECT handle, x, y, z FROM vtx UNION ALL SELECT (SELECT max(handle) FROM vtx) + n, x, y, z FROM (VALUES (1, 0.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE), (2, 3.0, 4.0, 5.0)) t(n, x, y, z)")
on_orders("m02_set_coords", lambda m: mutation.set_coordinates(m, m.vertices.filter("handle % 2 = 0").withColumn("x", F.lit(-1.0))).vertices, "SELECT handle, CASE WHEN handle % 2 = 0 THEN -1.0 ELSE x END AS x, y, z FROM vtx")
on_orders("m03_delete", lambda m: _left(mutation.delete(m, handles_of(m, "handle % 3 = 0"))), "SELECT (SELECT count(*) FROM elem WHERE handle % 3 <> 0) AS elements, (SELECT count(*) FROM members WHERE entity % 3 <> 0 OR entity >= %d) AS members, (SELECT count(*) FROM eo WHERE handle %% 3 <> 0) AS prices".replace("%d", str(SET)).replace("%%", "%"))
on_orders("m04_merge_vertices", lambda m: mutation.merge_entities(m, 10, 12).elements.filter(F.array_contains("conn", 10)).select("handle", F.concat_ws(",", F.transform("conn", lambda v: v.cast("string"))).alias("conn")), "SELECT handle, array_to_string(list_transform(conn, lambda v: CASE WHEN v = 12 THEN 10 ELSE v END), ',') AS conn FROM elem WHERE list_contains(conn, 10) OR list_contains(conn, 12)")
on_orders("m07_merge_by_tag", lambda m: mutation.merge_by_tag(m, m.vertices.select(H().alias("entity"), (F.col("y") % 50).cast("long").alias("value"))), "SELECT handle, keep FROM (SELECT handle, min(handle) OVER (PARTITION BY (y % 50)::BIGINT) AS keep FROM vtx) WHERE handle <> keep")
on_orders("m08_merge_elements", lambda m: mutation.merge_elements(m, 1).elements.filter("etype = 1").select("handle"), "SELECT min(handle) AS handle FROM elem WHERE etype = 1 GROUP BY list_sort(conn)")
on_orders("m10_reorder", lambda m: mutation.reorder(m.tag("PRICE").values), "SELECT a.handle, b.handle AS new FROM (SELECT handle, handle >> 56 AS t, row_number() OVER (PARTITION BY handle >> 56 ORDER BY round(o_totalprice * 100)::BIGINT, handle) AS n FROM eo) a JOIN (SELECT handle, handle >> 56 AS t, row_number() OVER (PARTITION BY handle >> 56 ORDER BY handle) AS n FROM eo) b USING (t, n)")


def _left(m):
    return m.spark.range(1).select(F.lit(m.elements.count()).cast("long").alias("elements"), F.lit(m.members.count()).cast("long").alias("members"), F.lit(m.tags["PRICE"].values.count()).cast("long").alias("prices"))


# flagship: orders of a region, by tag, with the mean retail price of their parts -------------
def _flagship(m):
    asia = entities.by_type_and_tag(m, model.TRI, ["PRIORITY"], ["1-URGENT"], meshset=SET + REGION + 2, recursive=True)
    inc = m.incidence().join(asia.select(H().alias("elem")), "elem", "left_semi")
    price = m.tag("RETAIL").values.withColumnRenamed("entity", "vertex")
    return inc.join(price, "vertex").groupBy(F.col("elem").alias("handle")).agg(F.count("*").alias("n"), F.sum("value").alias("cents"))


on_orders("slice_region_tag_mean", _flagship, f", rec AS (SELECT {SET + REGION + 2} AS s UNION ALL SELECT entity FROM rec JOIN members ON \"set\" = s WHERE entity >= {SET}) SELECT elem AS handle, count(*) AS n, sum(round(p_retailprice * 100)::BIGINT)::BIGINT AS cents FROM inc JOIN part ON vertex = p_partkey + 1 WHERE elem IN (SELECT entity FROM members JOIN rec ON \"set\" = s) AND elem IN (SELECT handle FROM eo WHERE o_orderpriority = '1-URGENT' AND (handle >> 56) = 2) GROUP BY 1")

# shared copies: parts of customers' orders ---------------------------------------------------
_COPIES = ", cp AS (SELECT vertex AS gid, o_custkey % 8 AS part, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS value FROM inc JOIN eo ON elem = handle GROUP BY 1, 2) "


def copies(m, s, d):
    cust = table(s, d, "orders").select(F.col("o_orderkey"), (F.col("o_custkey") % 8).alias("part"))
    price = m.tag("PRICE").values.withColumnRenamed("entity", "elem")
    inc = m.incidence().join(price, "elem").withColumn("o_orderkey", model.id_of(F.col("elem")) - 1).join(cust, "o_orderkey")
    return inc.groupBy(F.col("vertex").alias("gid"), F.col("part").cast("long").alias("part")).agg(F.sum("value").alias("value"))


def on_copies(name, run, sql):
    add(name, lambda s, d: run(copies(orders_mesh(s, d), s, d)), ORDERS_SQL + _COPIES + sql)


on_copies("h10_reduce_sum", lambda c: fields.reduce_shared(c, "sum"), "SELECT gid, sum(value)::BIGINT AS value FROM cp GROUP BY 1")
on_copies("h10_reduce_max", lambda c: fields.reduce_shared(c, "max"), "SELECT gid, max(value) AS value FROM cp GROUP BY 1")
on_copies("h10_reduce_bits", lambda c: fields.reduce_shared(c, "bor"), "SELECT gid, bit_or(value) AS value FROM cp GROUP BY 1")
on_copies("h11_exchange", lambda c: fields.exchange(c), "SELECT gid, part::BIGINT AS part, first_value(value) OVER (PARTITION BY gid ORDER BY part) AS value FROM cp")
on_copies("d01_shared", lambda c: _sharing(c), "SELECT gid, count(*) AS n_parts, min(part)::BIGINT AS owner FROM cp GROUP BY 1 HAVING count(*) > 1")
on_copies("d03_status", lambda c: _status(c), "SELECT gid, part::BIGINT AS part, ((CASE WHEN part <> min(part) OVER w THEN 1 ELSE 0 END) + (CASE WHEN count(*) OVER w > 1 THEN 2 ELSE 0 END) + (CASE WHEN count(*) OVER w > 2 THEN 4 ELSE 0 END) + (CASE WHEN count(*) OVER w > 1 THEN 8 ELSE 0 END))::BIGINT AS status FROM cp WINDOW w AS (PARTITION BY gid)")
on_orders("h14_global_ids", lambda m: fields.global_ids(m.elements.select("handle")), "SELECT handle, row_number() OVER (ORDER BY handle) AS gid FROM elem")
on_orders("f21_part_of_sets", lambda m: fields.spread(m.sets.select("handle"), 7).select(F.col("part").cast("long"), "handle"), "SELECT (ntile(7) OVER (ORDER BY handle) - 1)::BIGINT AS part, handle FROM sets")
on_orders("f22_tag_values", lambda m: m.tag("PRIORITY").values.select("value").distinct(), "SELECT '1-URGENT' AS value")
on_orders("h06_matching_sets", lambda m: fields.matching_sets([m.sets.select(H().alias("entity"), (H() % 3).alias("value")), m.sets.select(H().alias("entity"), F.col("flags").alias("value"))]).select("tuple", F.size("sets").cast("long").alias("n"), F.element_at("sets", 1).alias("first")), "SELECT (handle % 3) || ',' || flags AS tuple, count(*) AS n, min(handle) AS first FROM sets GROUP BY 1")


def _sharing(c):
    from ..operators.distribution import shared

    return shared(c)


def _status(c):
    from ..operators.distribution import status

    return status(c).select("gid", "part", F.col("status").cast("long"))
