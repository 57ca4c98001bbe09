"""Queries of status, recall, snippet and localization operators with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from symbolweave.operators import upkeep
from symbolweave.projection import GRAPH_SQL, stored_graph

ENDS = [".rs", ".swift", ".xcstrings", ".xcassets/set.json", ".md"]
SPACE = upkeep.SPACE


def _changed(spark, sf_dir):
    """Files of nations: stamps are counts of customers when indexed, of suppliers now."""
    place = spark.read.parquet(f"{sf_dir}/nation.parquet")
    path = F.concat(F.lit("geo/"), "n_name", F.element_at(F.array(*map(F.lit, ENDS)), F.col("n_regionkey").cast("int") + 1))
    stamps = lambda name, key: spark.read.parquet(f"{sf_dir}/{name}.parquet").groupBy(F.col(key).alias("n_nationkey")).agg(F.count("*").alias("stamp")).join(F.broadcast(place), "n_nationkey").select(path.alias("path"), "stamp")
    return upkeep.changed_files(stamps("customer", "c_nationkey"), stamps("supplier", "s_nationkey"))


CHANGED_SQL = f"""WITH pl AS (SELECT n_nationkey AS nk, 'geo/' || n_name || [{', '.join(repr(x) for x in ENDS)}][n_regionkey + 1] AS path FROM nation),
a AS (SELECT path, count(*) AS stamp FROM customer JOIN pl ON nk = c_nationkey GROUP BY path), b AS (SELECT path, count(*) AS stamp FROM supplier JOIN pl ON nk = s_nationkey GROUP BY path),
ch AS (SELECT path, CASE WHEN path LIKE '%.xcassets/%' THEN 'assets' WHEN path LIKE '%.swift' OR path LIKE '%.rs' THEN 'graph' WHEN path LIKE '%.xcstrings' THEN 'localization' END AS kind
 FROM a FULL JOIN b USING (path) WHERE a.stamp IS DISTINCT FROM b.stamp)"""


def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _recall(spark, sf_dir):
    graph, session = stored_graph(spark, sf_dir), upkeep.Recall()
    session.ids["order_"] = "o:1"
    return session.resolve(graph, "order_")


def _localize(spark, sf_dir):
    from symbolweave.plans.knowledge import string_tables

    usages, catalog, wrappers, _ = string_tables(spark, sf_dir)
    return upkeep.localize(stored_graph(spark, sf_dir), "n:1", usages, catalog, wrappers)


TRIM = f"regexp_replace(regexp_replace(x, '{SPACE}+\\z', ''), '^{SPACE}+', '')"
COMPACT_SQL = f"""WITH c AS (SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: {TRIM}), lambda x: x <> ''), ' ') AS s FROM documents)
SELECT doc_id, CASE WHEN strlen(s) <= 600 THEN s ELSE regexp_replace(left(s, CAST(list_max(list_filter(range(150, 601), lambda n: strlen(left(s, CAST(n AS BIGINT))) <= 600)) AS BIGINT)), '{SPACE}+\\z', '') || ' ...' END AS snippet FROM c"""
LINES_SQL = f"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), s AS (SELECT doc_id, CASE WHEN len(ls) > 1 THEN regexp_replace(array_to_string(ls[2:4], chr(10)), '[\\r\\n]+\\z', '') END AS s FROM l),
t AS (SELECT doc_id, s, list_transform(string_split(s, chr(10)), lambda x: regexp_replace(x, '{SPACE}+\\z', '')) AS ls FROM s),
i AS (SELECT doc_id, s, ls, coalesce(list_min(list_transform(list_filter(ls, lambda x: x <> ''), lambda x: length(x) - length(regexp_replace(x, '^{SPACE}+', '')))), 0) AS ind FROM t)
SELECT doc_id, CASE WHEN s IS NOT NULL THEN regexp_replace(array_to_string(list_transform(ls, lambda x: substring(x, ind + 1)), chr(10)), '^\\n+|\\n+\\z', '', 'g') END AS snippet FROM i"""

QUERIES = {
    "status_changed_files": (_changed, CHANGED_SQL + " SELECT * FROM ch"),
    "index_status": (lambda s, d: upkeep.index_status(_changed(s, d)), CHANGED_SQL + " SELECT count(*) AS changed_files, count(kind) AS changed_inputs, false AS temporary, count(kind) > 0 AS may_be_stale, true AS tracked FROM ch"),
    "work_plan": (lambda s, d: upkeep.work_plan(_changed(s, d)), CHANGED_SQL + " SELECT coalesce(bool_or(kind = 'graph'), false) AS graph, coalesce(bool_or(kind = 'localization'), false) AS localization, coalesce(bool_or(kind = 'assets'), false) AS assets FROM ch"),
    "freshness": (lambda s, d: upkeep.freshness(upkeep.index_status(_changed(s, d))), CHANGED_SQL + " SELECT 'resolved_index_matches' AS result_scope, CASE WHEN count(kind) > 0 THEN 'stale' ELSE 'current' END AS freshness, count(kind) AS changed_inputs FROM ch"),
    "recall_resolution": (_recall, GRAPH_SQL + " SELECT id, name, kind, 4 AS tier FROM nodes WHERE id = 'o:1'"),
    "compact_snippets": (lambda s, d: _docs(s, d).select("doc_id", upkeep.compact(F.col("text")).alias("snippet")), COMPACT_SQL),
    "snippet_lines": (lambda s, d: _docs(s, d).select("doc_id", upkeep.deindent(upkeep.full_lines(F.col("text"), F.lit(1), F.lit(3))).alias("snippet")), LINES_SQL),
    "localize_subtree": (_localize, GRAPH_SQL + """, us AS (SELECT 'o:' || o_orderkey AS id, 'order_' || o_orderkey AS name, CAST(2 AS INTEGER) AS depth, o_orderpriority AS p, o_orderstatus AS s FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 1)
 SELECT id, name, depth, CASE WHEN p IN ('1-URGENT', '2-HIGH', '4-NOT SPECIFIED', '5-LOW') THEN 'L' WHEN s = 'O' THEN 'M' END AS "table",
 CASE WHEN p IN ('1-URGENT', '2-HIGH') THEN p WHEN p = '4-NOT SPECIFIED' THEN 'not_specified' WHEN p = '5-LOW' THEN 'low_text' WHEN s = 'O' THEN 'O' END AS key,
 CASE WHEN p IN ('1-URGENT', '2-HIGH', '4-NOT SPECIFIED') THEN 'orders/L.strings' WHEN p = '5-LOW' THEN 'crm/L.strings' WHEN s = 'O' THEN 'orders/M.strings' END AS catalog_file,
 CASE WHEN p IN ('1-URGENT', '2-HIGH') THEN 'direct_metadata' WHEN p = '4-NOT SPECIFIED' THEN 'wrapper_name_key' WHEN p = '5-LOW' THEN 'wrapper_name_approximate' WHEN s = 'O' THEN 'literal_key' ELSE 'unmatched' END AS match_kind FROM us"""),
}
