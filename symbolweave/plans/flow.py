"""Queries of the flow operators with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from symbolweave.graph import CodeGraph
from symbolweave.operators import flow
from symbolweave.projection import GRAPH_SQL, stored_graph

DEP = """, solid AS (SELECT id FROM nodes WHERE kind NOT IN ('view', 'branch')),
dep AS MATERIALIZED (SELECT DISTINCT e.target AS src, e.source AS dst FROM edges e WHERE kind IN ('calls','reads','implements','type_ref','inherits') AND source IN (FROM solid) AND target IN (FROM solid)),
walk(id, depth) AS (SELECT 's:1', 0
  UNION SELECT dst, depth + 1 FROM walk JOIN dep ON src = id WHERE depth < 3),
hit AS (SELECT id, min(depth) AS depth FROM walk GROUP BY id HAVING min(depth) > 0),
imp AS (SELECT 's:1' AS root, n.id, n.name, n.kind, n.file, coalesce(n.module, '<unknown>') AS module, n.visibility, h.depth,
  CASE WHEN h.depth >= 3 THEN 'depth3+' ELSE 'depth' || h.depth END AS bucket FROM hit h JOIN nodes n USING (id))"""
TRACE = """, fl AS MATERIALIZED (SELECT source, target, kind, direction, condition, coalesce(async_boundary, false) AS crosses FROM edges WHERE kind IN ('calls','reads','writes','publishes','subscribes')),
fr AS (SELECT target, kind, direction FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY source, kind, direction NULLS FIRST, condition NULLS FIRST) AS r FROM fl) WHERE r = 1),
way AS (SELECT id, [name] AS names, [id] AS ids, CAST([] AS VARCHAR[]) AS pairs, CAST([] AS VARCHAR[]) AS conditions, 0 AS asyncs, 0 AS hops, CAST(NULL AS VARCHAR) AS tk FROM nodes WHERE id = 'o:10'
 UNION ALL SELECT f.target, list_append(names, n.name), list_append(ids, f.target), list_append(pairs, f.source || ' -> ' || f.target),
  CASE WHEN f.condition IS NULL THEN conditions ELSE list_append(conditions, f.condition) END, asyncs + CAST(f.crosses AS INTEGER), hops + 1, n.terminal_kind
  FROM way w JOIN fl f ON f.source = w.id JOIN nodes n ON n.id = f.target
  WHERE hops < 4 AND (hops = 0 OR tk IS NULL) AND NOT list_contains(pairs, f.source || ' -> ' || f.target)),
tr AS (SELECT array_to_string(names, ' > ') AS path, array_to_string(ids, ' > ') AS path_ids, hops, id AS terminal_id, tk AS terminal_kind,
  coalesce(fr.direction, CASE fr.kind WHEN 'reads' THEN 'read' WHEN 'writes' THEN 'write' ELSE 'unknown' END) AS direction, CAST(NULL AS VARCHAR) AS operation,
  array_to_string(conditions, ',') AS conditions, asyncs FROM way JOIN fr ON fr.target = way.id WHERE tk IS NOT NULL AND hops > 0)"""

IMPACT_TREE = """, w1 AS MATERIALIZED (SELECT n.id, 1 AS depth, [n.name, n.file, n.id] AS way FROM (SELECT DISTINCT dst FROM dep WHERE src = 's:1' AND dst <> 's:1') JOIN nodes n ON n.id = dst),
w2 AS MATERIALIZED (SELECT n.id, 2 AS depth, min(list_concat(w1.way, [n.name, n.file, n.id])) AS way FROM w1 JOIN dep ON src = w1.id JOIN nodes n ON n.id = dst WHERE dst <> 's:1' AND dst NOT IN (SELECT id FROM w1) GROUP BY n.id),
w3 AS MATERIALIZED (SELECT n.id, 3 AS depth, min(list_concat(w2.way, [n.name, n.file, n.id])) AS way FROM w2 JOIN dep ON src = w2.id JOIN nodes n ON n.id = dst WHERE dst <> 's:1' AND dst NOT IN (SELECT id FROM w1 UNION ALL SELECT id FROM w2) GROUP BY n.id),
pl AS (SELECT *, CAST(row_number() OVER (PARTITION BY depth ORDER BY way) AS INTEGER) AS place, count(*) OVER (PARTITION BY depth) AS total FROM (FROM w1 UNION ALL FROM w2 UNION ALL FROM w3)),
kp AS MATERIALIZED (SELECT * FROM pl WHERE place <= 40)
SELECT 's:1' AS root, id, CASE depth WHEN 3 THEN 'depth3+' ELSE 'depth' || depth END AS bucket, depth, 's:1 > ' || way[3] || coalesce(' > ' || way[6], '') || coalesce(' > ' || way[9], '') AS path, place, total,
 (depth < 2 OR way[3] IN (SELECT id FROM kp)) AND (depth < 3 OR way[6] IN (SELECT id FROM kp)) AS in_tree FROM kp"""

FLOW = """, tg AS (SELECT id, name, CASE WHEN role_type = 'terminal' THEN terminal_kind END AS fin FROM nodes),
fl AS MATERIALIZED (SELECT e.*, t.name AS to_name, t.fin AS to_end, e.kind = 'calls' AND t.id IS NOT NULL AND t.fin IS NULL AS goes FROM edges e LEFT JOIN tg t ON t.id = e.target WHERE e.kind IN ('calls','reads','writes','publishes','subscribes')),
walk(id, depth) AS (SELECT 'o:10', 0 UNION SELECT target, depth + 1 FROM walk JOIN fl ON source = id AND goes WHERE depth < 10),
near AS (SELECT id FROM walk GROUP BY id HAVING min(depth) < 10),
lab AS (SELECT source, CASE WHEN goes THEN target ELSE 'effect::' || coalesce(to_end, CASE kind WHEN 'calls' THEN 'call' WHEN 'reads' THEN 'read' ELSE 'write' END) || '::'
  || coalesce(nullif(regexp_replace(regexp_replace(lower(to_name), '[^a-z0-9]', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'unknown') || '::unknown' END AS target,
  CASE WHEN goes THEN 'call' WHEN direction IS NOT NULL THEN direction WHEN kind = 'calls' THEN 'call' WHEN kind = 'reads' THEN 'read' ELSE 'write' END AS kind, condition, async_boundary FROM fl WHERE source IN (FROM near)),
df AS (SELECT source, target, kind, CAST(NULL AS VARCHAR) AS operation, coalesce(string_agg(DISTINCT condition, ',' ORDER BY condition), '') AS conditions, coalesce(bool_or(async_boundary), false) AS async_boundary FROM lab GROUP BY source, target, kind)"""

REVERSE = """, fl AS MATERIALIZED (SELECT DISTINCT source, target FROM edges WHERE kind IN ('calls','reads','writes','publishes','subscribes') AND source <> target AND target IN (SELECT id FROM nodes)),
walk(id, depth) AS (SELECT 'p:1', 0 UNION SELECT source, depth + 1 FROM walk JOIN fl ON target = id),
near AS MATERIALIZED (SELECT id, min(depth) AS depth FROM walk GROUP BY id),
up AS MATERIALIZED (SELECT n.id, min(m.id) AS parent FROM near n JOIN fl ON fl.source = n.id JOIN near m ON m.id = fl.target AND m.depth = n.depth - 1 GROUP BY n.id),
way(id, spot, path) AS (SELECT id, id, id FROM near UNION ALL SELECT way.id, parent, path || ' > ' || parent FROM way JOIN up ON up.id = way.spot),
rev AS (SELECT n.id, n.name, n.module, n.file, near.depth AS distance, way.path FROM near JOIN nodes n USING (id) JOIN way ON way.id = near.id AND way.spot = 'p:1' WHERE n.role_type = 'entry_point')"""

#: Accessors of parts: a getter of each, a setter of the larger ones; some functions have an accessor's name or an edge, but not both.
ACCESSORS = """, cl AS (SELECT 'p:' || p_partkey AS id, 'g:' || p_partkey AS cluster FROM part UNION ALL SELECT 'g:' || p_partkey, 'g:' || p_partkey FROM part
 UNION ALL SELECT 't:' || p_partkey, CASE WHEN p_size > 25 THEN 'g:' || p_partkey ELSE 't:' || p_partkey END FROM part UNION ALL SELECT id, id FROM nodes WHERE kind <> 'property')"""
FALLBACK = """, vn AS (SELECT id, kind, CASE WHEN kind = 'function' AND start_line % 70 = 0 THEN 'getter:body' WHEN kind = 'function' AND start_line % 30 = 0 THEN 'handle_' || name WHEN kind = 'struct' THEN 'on_' || name ELSE name END AS name,
 CASE WHEN kind IN ('struct', 'function', 'class') THEN 'one.rs' ELSE file END AS file FROM nodes),
 cb AS (SELECT target AS id FROM edges WHERE kind IN ('contains', 'type_ref') AND source = 'c:1')"""


def _accessors(s, d):
    g = stored_graph(s, d)
    parts = g.nodes.where("kind = 'property'")
    size = s.read.parquet(f"{d}/part.parquet").select(F.concat(F.lit("p:"), F.col("p_partkey").cast("string")).alias("id"), "p_size")
    side = lambda p, way: parts.withColumns({"id": F.regexp_replace("id", "^p", p), "kind": F.lit("function"), "name": F.concat(F.lit(way), "name")})
    edge = lambda p, df: g.edges.limit(0).unionByName(df.select(F.regexp_replace("id", "^p", p).alias("source"), F.col("id").alias("target"), F.lit("implements").alias("kind")), allowMissingColumns=True)
    edges = g.edges.unionByName(edge("g", size)).unionByName(edge("t", size.where("p_size > 25")))
    return flow.accessor_clusters(CodeGraph(g.nodes.unionByName(side("g", "getter:")).unionByName(side("t", "setter:")), edges))


def _fallback(s, d):
    """All orders and customers in one file, some orders named as actions or bodies, customers as if they were actions."""
    g, kind = stored_graph(s, d), F.col("kind")
    name = F.when((kind == "function") & (F.col("start_line") % 70 == 0), "getter:body").when((kind == "function") & (F.col("start_line") % 30 == 0), F.concat(F.lit("handle_"), "name")).when(kind == "struct", F.concat(F.lit("on_"), "name")).otherwise(F.col("name"))
    nodes = g.nodes.withColumns({"name": name, "file": F.when(kind.isin("struct", "function", "class"), "one.rs").otherwise(F.col("file"))})
    return flow.fallback_roots(CodeGraph(nodes, g.edges), "c:1")


def _impact(s, d):
    return flow.impact(stored_graph(s, d), ["s:1"], 3)


QUERIES = {
    "impact_supplier_d3": (_impact, GRAPH_SQL + DEP + " SELECT * FROM imp"),
    "impact_tree": (lambda s, d: flow.impact_tree(stored_graph(s, d), ["s:1"], 3, 40), GRAPH_SQL + DEP + IMPACT_TREE),
    "impact_summary": (lambda s, d: flow.impact_summary(_impact(s, d)), GRAPH_SQL + DEP + """ SELECT root, CAST(count(*) FILTER (depth = 1) AS BIGINT) AS direct, count(*) AS total, count(DISTINCT file) AS files, count(DISTINCT module) AS modules,
 CAST(count(*) FILTER (visibility = 'public') AS BIGINT) AS public, CAST(count(*) FILTER (visibility <> 'public') AS BIGINT) AS internal FROM imp GROUP BY root"""),
    "impact_top_modules": (lambda s, d: flow.impact_top_modules(_impact(s, d)), GRAPH_SQL + DEP + " SELECT module, count(*) AS affected FROM imp GROUP BY module ORDER BY affected DESC, module LIMIT 5"),
    "reverse_entries": (lambda s, d: flow.reverse_entries(stored_graph(s, d), "p:1"), GRAPH_SQL + REVERSE + " SELECT * FROM rev"),
    "components_accessors": (_accessors, GRAPH_SQL + ACCESSORS + " SELECT id, cluster FROM cl"),
    "trace_paths_d4": (lambda s, d: flow.trace(stored_graph(s, d), "o:10", 4), GRAPH_SQL + TRACE + " SELECT * FROM tr"),
    "trace_summary": (lambda s, d: flow.trace_summary(flow.trace(stored_graph(s, d), "o:10", 4)), GRAPH_SQL + TRACE + """ SELECT count(*) AS flows, count(*) FILTER (direction IN ('read', 'read_write')) AS reads, count(*) FILTER (direction IN ('write', 'read_write')) AS writes, CAST(coalesce(sum(asyncs), 0) AS BIGINT) AS async_crossings FROM tr"""),
    "trace_fallback_roots": (_fallback, GRAPH_SQL + FALLBACK + """ SELECT id, name, CASE WHEN name = 'getter:body' THEN 0 WHEN starts_with(name, 'handle_') THEN 1 ELSE 2 END AS rank FROM vn
 WHERE id IN (FROM cb) AND file = 'one.rs' AND (name = 'getter:body' OR starts_with(name, 'handle_') OR id IN (SELECT source FROM edges WHERE kind IN ('calls','reads','writes')))"""),
    "entries_ranked": (lambda s, d: flow.entries(stored_graph(s, d)), GRAPH_SQL + """ SELECT id, name, module, file, CASE WHEN visibility = 'public' THEN 2 ELSE 3 END AS rank, count(*) OVER () AS total FROM nodes WHERE role_type = 'entry_point'"""),
    "dataflow_edges": (lambda s, d: flow.dataflow(stored_graph(s, d), "o:10"), GRAPH_SQL + FLOW + " SELECT * FROM df"),
    "dataflow_limited": (lambda s, d: flow.dataflow_limited(flow.dataflow(stored_graph(s, d), "o:10"), "o:10", 10), GRAPH_SQL + FLOW + """,
 fst AS MATERIALIZED (SELECT * FROM df ORDER BY source, target, list_position(['call', 'read', 'write', 'publish', 'subscribe'], kind), operation NULLS FIRST LIMIT 10)
 SELECT 'edge' AS item, source, target, kind, operation, (SELECT count(*) FROM df) AS total FROM fst
 UNION ALL SELECT 'node', id, NULL, CASE WHEN starts_with(id, 'effect::') THEN 'effect' ELSE 'symbol' END, NULL, (SELECT count(*) FROM (SELECT source FROM df UNION SELECT target FROM df UNION SELECT 'o:10'))
 FROM (SELECT source AS id FROM fst UNION SELECT target FROM fst UNION SELECT 'o:10')"""),
    "dataflow_summary": (lambda s, d: flow.dataflow_summary(flow.dataflow(stored_graph(s, d), "o:10")), GRAPH_SQL + FLOW + """, both_ends AS (SELECT source AS id FROM df UNION SELECT target FROM df)
 SELECT (SELECT count(*) FROM both_ends WHERE NOT starts_with(id, 'effect::')) AS symbols, (SELECT count(*) FROM both_ends WHERE starts_with(id, 'effect::')) AS effects, count(*) AS edges,
 count(*) FILTER (kind = 'call') AS calls, count(*) FILTER (kind = 'read') AS reads, count(*) FILTER (kind = 'write') AS writes, CAST(0 AS BIGINT) AS publishes, CAST(0 AS BIGINT) AS subscribes FROM df"""),
}
