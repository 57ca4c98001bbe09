"""Queries of structure, health, search and record operators with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from symbolweave.functions.text import search_terms
from symbolweave.operators import health, records, search, structure
from symbolweave.projection import GRAPH_SQL, stored_graph
from symbolweave.runtime import shared_dir

G = stored_graph
LAYERS = [("ui", ["CRM\\*"]), ("infra", ["catalog/*"]), ("core", ["orders/*"]), ("supply", ["SUPPLY/*"]), ("places", ["geo/*"])]
DENY = [("core", "infra", "replaced below"), ("ui", "core", None), ("Core", "INFRA", "orders must not touch the catalog"), ("ui", "supply", "ask the orders"), ("supply", "places", None)]
LAYER_SQL = """, ly AS (SELECT id, CASE WHEN starts_with(lower(file), 'crm/') THEN 'ui' WHEN starts_with(lower(file), 'catalog/') THEN 'infra' WHEN starts_with(lower(file), 'orders/') THEN 'core' WHEN starts_with(lower(file), 'supply/') THEN 'supply' WHEN starts_with(lower(file), 'geo/') THEN 'places' END AS layer FROM nodes)"""
SMELL_SQL = """, ty AS (SELECT id FROM nodes WHERE kind IN ('struct','class','enum','protocol','trait')),
im AS (SELECT DISTINCT target AS id, source AS by FROM edges WHERE kind = 'implements' AND target IN (FROM ty)),
mi AS (SELECT im.id, count(*) FILTER (n.kind IN ('property','field')) AS properties, count(*) FILTER (n.kind IN ('function','method')) AS methods, count(*) FILTER (n.invalidation) AS invalidation FROM im JOIN nodes n ON n.id = im.by GROUP BY im.id),
dn(root, id, depth) AS (SELECT id, id, 0 FROM ty UNION SELECT root, e.target, depth + 1 FROM dn JOIN edges e ON e.source = dn.id AND e.kind = 'contains'),
dp AS (SELECT root AS id, CAST(max(depth) AS INTEGER) AS depth FROM dn GROUP BY root),
kd AS (SELECT source AS id, count(DISTINCT target) AS children FROM edges WHERE kind = 'contains' GROUP BY source),
mt AS (SELECT ty.id, coalesce(properties, 0) AS properties, coalesce(methods, 0) AS methods, coalesce(invalidation, 0) AS invalidation, dp.depth, coalesce(children, 0) AS children FROM ty LEFT JOIN mi USING (id) JOIN dp USING (id) LEFT JOIN kd USING (id)),
fo AS (SELECT source AS id, count(*) AS n FROM edges WHERE kind = 'calls' GROUP BY source HAVING count(*) > 15), fi AS (SELECT target AS id, count(*) AS n FROM edges WHERE kind = 'calls' GROUP BY target HAVING count(*) > 15),
sm AS (SELECT id, 'god_type' AS smell, CAST(properties AS BIGINT) AS metric, CASE WHEN properties > 25 THEN 'critical' ELSE 'warning' END AS severity FROM mt WHERE properties > 15
 UNION ALL SELECT id, 'wide_invalidation', CAST(invalidation AS BIGINT), CASE WHEN invalidation > 8 THEN 'critical' ELSE 'warning' END FROM mt WHERE invalidation > 5
 UNION ALL SELECT id, 'deep_nesting', CAST(depth AS BIGINT), 'warning' FROM mt WHERE depth > 5
 UNION ALL SELECT id, 'high_fan_out', n, 'warning' FROM fo WHERE id IN (SELECT id FROM nodes WHERE kind = 'function') UNION ALL SELECT id, 'high_fan_in', n, 'warning' FROM fi WHERE id IN (SELECT id FROM nodes WHERE kind = 'function'))"""
TERMS_SQL = """WITH tk AS (SELECT doc_id, list_sort(list_distinct(list_filter(string_split(lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(concat_ws(' ', coalesce(source, ''), coalesce(text, '')),
 '([a-z])([A-Z])', '\\1 \\2', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Za-z])([0-9])', '\\1 \\2', 'g'), '([A-Za-z])([0-9])', '\\1 \\2', 'g'), '([0-9])([A-Za-z])', '\\1 \\2', 'g'), '([0-9])([A-Za-z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+', ' ', 'g'))), ' '), lambda x: x <> ''))) AS terms FROM documents)"""
BM25_SQL = TERMS_SQL + """, po AS (SELECT doc_id, unnest(terms) AS term, len(terms) AS len FROM tk), st AS (SELECT count(*) AS n, avg(len(terms)) AS al FROM tk),
ht AS (SELECT * FROM po WHERE term IN ({terms})), df AS (SELECT term, count(*) AS df FROM ht GROUP BY term),
bm AS (SELECT doc_id AS id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * len / al))) AS score, count(*) AS matched FROM ht JOIN df USING (term), st GROUP BY doc_id)"""
QUERY = "the of and license version"
IN = ", ".join(f"'{t}'" for t in search.query_terms(QUERY))


_INDEXES: dict[tuple[str, str, str], str] = {}


def stored_index(s, d, name: str, build) -> search.SearchIndex:
    """The index that build() makes, written once in an application."""
    key = s.sparkContext.applicationId, d, name
    if key not in _INDEXES:
        path = f"{shared_dir(s)}/index-{name}-{uuid.uuid4().hex}"
        build().write(path)
        _INDEXES[key] = path
    return search.SearchIndex.read(s, _INDEXES[key])


def corpus(s, d):
    docs = s.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), "source", "text")
    terms = search_terms(F.coalesce("source", F.lit("")), F.coalesce("text", F.lit("")))
    # the texts stay where they are
    return stored_index(s, d, "documents", lambda: search.SearchIndex.build(docs.select("id", "source", terms.alias("terms")), {"terms": F.col("terms")}, sets=("terms",)).slim("id", "source"))


def nodes_index(s, d):
    return stored_index(s, d, "nodes", lambda: search.node_index(G(s, d), structure.locators(G(s, d))))


def _hunks(s, d):
    """A hunk of each part row, and one of the two lines after each line item's spot."""
    parts = s.read.parquet(f"{d}/part.parquet").selectExpr("concat('catalog/', p_type, '.rs') AS file", "CAST(p_partkey * 10 + 5 AS INT) AS start_line", "CAST(p_partkey * 10 + 12 AS INT) AS end_line")
    at = "l_orderkey * 10 + l_linenumber"
    return parts.unionByName(s.read.parquet(f"{d}/lineitem.parquet").selectExpr("'orders/lines.rs' AS file", f"CAST({at} + 1 AS INT) AS start_line", f"CAST({at} + 2 AS INT) AS end_line"))


def _next(g):
    """A later version: some names changed, some nodes gone, some confidences changed, some edges gone."""
    from symbolweave.graph import CodeGraph

    n = g.nodes.where("NOT (kind = 'struct' AND start_line % 70 = 0)").withColumn("name", F.when(F.expr("kind = 'property' AND start_line % 130 = 0"), F.concat("name", F.lit("2"))).otherwise(F.col("name")))
    e = g.edges.where("NOT (kind = 'type_ref' AND target LIKE '%7')").withColumn("confidence", F.when(F.expr("kind = 'implements' AND source LIKE '%3'"), 0.5).otherwise(F.col("confidence")))
    return CodeGraph(n, e)


def _events(s, d):
    return s.read.parquet(f"{d}/events.parquet")


def _history(s, d):
    e = _events(s, d).select(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("kind"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.array(F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("modules"), F.array().cast("array<string>").alias("files"), F.array().cast("array<string>").alias("symbols"))
    return records.history(e, kind="error").select("id", "kind", "timestamp", F.array_join("modules", ",").alias("modules"))


def _annotations(s, d):
    return records.latest(_events(s, d).select(F.lit("p").alias("project_id"), F.lit("").alias("branch"), F.lit("").alias("repo"), F.col("user_id").cast("string").alias("symbol_key"), F.col("event_type").alias("text"), F.col("event_id").cast("string").alias("created_at"), F.col("event_id").cast("string").alias("updated_at"))).select("symbol_key", "text", "updated_at")


def _bursts(s, d):
    from symbolweave.streaming.feed import bursts

    e = _events(s, d).select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    return bursts(e, "6 hours").groupBy("key").agg(F.count("*").alias("bursts"), F.max("n").alias("largest"))


def _delta(s, d):
    g = G(s, d)
    return g.delta(_next(g))


def _raw(g):
    """All edges as an extractor would leave them: reads by a path, calls among orders by bare names, supertypes unknown."""
    kind, target = F.col("kind"), F.col("target")
    named = F.when(kind == "reads", F.concat(F.lit("Catalog::"), target)).when(kind == "implements", F.lit("Nobody"))
    named = named.when((kind == "calls") & F.col("direction").isNull(), F.regexp_replace(target, "^o:", "order_")).otherwise(target)
    return g.edges.withColumn("target", named).dropDuplicates(["source", "target", "kind", "direction", "condition"])


def _link(s, d):
    g = G(s, d)
    return records.link_stats(records.link(g.nodes, _raw(g)))


def _linked(s, d):
    g = G(s, d)
    return records.link(g.nodes, _raw(g)).select("source", "target", "kind", "confidence", "rule", "reason")


def _files(s, d):
    files = s.read.parquet(f"{d}/part.parquet").selectExpr("concat('catalog/', split(p_type, ' ')[0], '/', p_brand, '.rs') AS file").distinct()
    modules = s.createDataFrame([("promo", "catalog/PROMO"), ("catalog", "catalog/")], "module string, dir string")
    return structure.module_of_files(files, modules)


def bm25(found):
    return found.select("id", F.round("score", 6).alias("score"), "matched")


def bands(s, d):
    return records.banded(bm25(corpus(s, d).any_terms(QUERY)), normalise=True)


#: The keys of S.edge_id, where operation and repo are null; of edges with one key, the largest confidence.
DELTA_SQL = GRAPH_SQL + """, ky AS (SELECT *, sha256(concat(source, chr(31), target, chr(31), kind, chr(31), coalesce(direction, ''), chr(31), chr(31), coalesce(condition, ''), chr(31), coalesce(CAST(async_boundary AS VARCHAR), ''), chr(31))) AS key FROM edges),
 was AS (SELECT key, max(confidence) AS c, list_sort(list(DISTINCT spot)) AS at FROM ky GROUP BY key),
 now AS (SELECT key, max(CASE WHEN kind = 'implements' AND source LIKE '%3' THEN 0.5 ELSE confidence END) AS c, list_sort(list(DISTINCT spot)) AS at FROM ky WHERE NOT (kind = 'type_ref' AND target LIKE '%7') GROUP BY key)
 SELECT 'node' AS item, id AS key, CASE kind WHEN 'struct' THEN 'deleted' ELSE 'updated' END AS change_type FROM nodes WHERE kind = 'struct' AND start_line % 70 = 0 OR kind = 'property' AND start_line % 130 = 0
 UNION ALL SELECT 'edge', key, CASE WHEN now.c IS NULL THEN 'deleted' WHEN was.c IS NULL THEN 'added' ELSE 'updated' END FROM was FULL JOIN now USING (key) WHERE was.c IS NULL OR now.c IS NULL OR was.c <> now.c OR was.at IS DISTINCT FROM now.at"""


QUERIES = {
    "module_summary": (lambda s, d: health.module_summary(G(s, d)), GRAPH_SQL + """, m AS (SELECT id, coalesce(module, '(unknown)') AS m, file, role_type FROM nodes), ow AS (SELECT m, count(*) AS symbol_count, count(DISTINCT file) AS file_count, count(*) FILTER (role_type = 'entry_point') AS entry_points, count(*) FILTER (role_type = 'terminal') AS terminals FROM m GROUP BY m),
 ed AS (SELECT a.m, count(*) AS edge_count, count(*) FILTER (b.m IS NOT NULL AND b.m <> a.m) AS cross_module_edges FROM edges e JOIN m a ON a.id = e.source LEFT JOIN m b ON b.id = e.target GROUP BY a.m)
 SELECT ow.m AS module, symbol_count, file_count, coalesce(edge_count, 0) AS edge_count, coalesce(cross_module_edges, 0) AS cross_module_edges, CAST(coalesce(round(cross_module_edges / edge_count, 2), 0) AS DOUBLE) AS coupling_ratio, entry_points, terminals FROM ow LEFT JOIN ed USING (m)"""),
    "module_kind_counts": (lambda s, d: health.module_kind_counts(G(s, d)), GRAPH_SQL + " SELECT coalesce(module, '(unknown)') AS module, replace(kind, '_', '') AS kind, count(*) AS n FROM nodes GROUP BY ALL"),
    "file_map": (lambda s, d: structure.file_map(G(s, d)), GRAPH_SQL + " SELECT coalesce(module, '(unknown)') AS module, regexp_extract(file, '^(.*/)', 1) AS directory, count(DISTINCT file) AS file_count, count(*) AS symbol_count FROM nodes GROUP BY ALL"),
    "file_symbols": (lambda s, d: structure.file_symbols(G(s, d), ["crm/BUILDING.rs", "nowhere.rs"]), GRAPH_SQL + " SELECT 'crm/BUILDING.rs' AS query, id, name, kind, start_line, file FROM nodes WHERE file = 'crm/BUILDING.rs' UNION ALL SELECT 'nowhere.rs', NULL, NULL, NULL, NULL, NULL"),
    "locators": (lambda s, d: structure.locators(G(s, d)), GRAPH_SQL + """, pa AS (SELECT target AS id, min(source) AS parent FROM edges WHERE kind = 'contains' GROUP BY target), ch(id, spot, owners) AS (SELECT id, id, CAST([] AS VARCHAR[]) FROM nodes UNION ALL SELECT ch.id, pa.parent, list_prepend(n.name, owners) FROM ch JOIN pa ON pa.id = ch.spot JOIN nodes n ON n.id = pa.parent),
 lg AS (SELECT id, arg_max(owners, len(owners)) AS owners FROM ch GROUP BY id) SELECT n.id, concat_ws('::', n.module, regexp_extract(file, '[^/]*$', 0), nullif(array_to_string(owners, '::'), ''), name) AS locator FROM nodes n JOIN lg USING (id)"""),
    "resolve_tiers": (lambda s, d: structure.resolve(G(s, d), "order_1"), GRAPH_SQL + " SELECT id, name, kind, 3 AS tier FROM nodes WHERE name = 'order_1'"),
    "contains_tree": (lambda s, d: structure.contains_tree(G(s, d), "r:1").select("path", "id", "name", "kind", "depth", "inline", "start_line"), GRAPH_SQL + """, tree(path, id, depth) AS (
 SELECT target, target, 1 FROM edges WHERE kind = 'contains' AND source = 'r:1' UNION ALL SELECT path || ' > ' || target, target, depth + 1 FROM tree JOIN edges ON source = tree.id AND kind = 'contains')
 SELECT path, id, name, kind, depth, false AS inline, start_line FROM tree JOIN nodes USING (id)"""),
    "context_sections": (lambda s, d: structure.context(G(s, d), "c:1"), GRAPH_SQL + """, mb AS (SELECT target AS m FROM edges WHERE kind = 'contains' AND source = 'c:1'), cx AS (
 SELECT DISTINCT CASE kind WHEN 'calls' THEN 'callers' WHEN 'reads' THEN 'read_by' ELSE 'implementors' END AS section, source AS id FROM edges WHERE kind IN ('calls','reads','implements') AND (target = 'c:1' OR target IN (FROM mb) AND source NOT IN (FROM mb) AND source <> 'c:1')
 UNION ALL SELECT CASE kind WHEN 'calls' THEN 'callees' WHEN 'type_ref' THEN 'type_refs' ELSE kind END, target FROM edges WHERE source = 'c:1' AND kind IN ('calls','reads','implements','type_ref','contains') UNION ALL SELECT 'contained_by', source FROM edges WHERE target = 'c:1' AND kind = 'contains')
 SELECT section, n.id, name, kind, file, count(*) OVER (PARTITION BY section) AS total FROM cx JOIN nodes n USING (id)"""),
    "invalidation_sources": (lambda s, d: structure.invalidation_sources(G(s, d), "o:3"), GRAPH_SQL + ", w(id) AS (SELECT 'o:3' UNION SELECT target FROM w JOIN edges ON source = id AND kind = 'reads') SELECT id, name FROM nodes WHERE invalidation AND id IN (FROM w)"),
    "symbol_usages": (lambda s, d: structure.usages(G(s, d), "p:2"), GRAPH_SQL + " SELECT e.target, e.source, n.name, n.file, e.kind, e.confidence, count(*) OVER () AS total FROM edges e JOIN nodes n ON n.id = e.source WHERE e.target = 'p:2' AND e.kind IN ('calls','reads','writes')"),
    "symbol_usages_type": (lambda s, d: structure.usages(G(s, d), "n:1"), GRAPH_SQL + """, tg AS (SELECT 'n:1' AS id UNION SELECT e.target FROM edges e JOIN nodes n ON n.id = e.target WHERE e.source = 'n:1' AND e.kind = 'contains' AND n.kind IN ('struct', 'protocol'))
 SELECT e.target, e.source, n.name, n.file, e.kind, e.confidence, count(*) OVER (PARTITION BY e.target) AS total FROM edges e JOIN nodes n ON n.id = e.source WHERE e.target IN (FROM tg) AND e.source NOT IN (FROM tg) AND e.kind IN ('calls','reads','writes','uses','type_ref','references','implements','instantiates','returns','type_of')"""),
    "api_surface": (lambda s, d: structure.api_surface(G(s, d), "c:1"), GRAPH_SQL + """, mb AS (SELECT id, name, kind, visibility FROM nodes WHERE id IN (SELECT target FROM edges WHERE kind = 'contains' AND source = 'c:1') AND visibility <> 'private' AND kind = 'function')
 SELECT *, 'c:1' AS owner, 'members' AS section FROM mb UNION ALL SELECT id, name, kind, visibility, NULL, 'referenced_types' FROM nodes WHERE id IN (SELECT target FROM edges WHERE kind IN ('type_ref', 'returns', 'type_of') AND source IN (SELECT id FROM mb))"""),
    "module_for_file": (_files, "SELECT DISTINCT 'catalog/' || split_part(p_type, ' ', 1) || '/' || p_brand || '.rs' AS file, CASE WHEN split_part(p_type, ' ', 1) = 'PROMO' THEN 'promo' ELSE 'catalog' END AS module FROM part"),
    "complexity_types": (lambda s, d: health.complexity(G(s, d)), GRAPH_SQL + SMELL_SQL + """, dq AS (SELECT im.id, count(DISTINCT e.target) AS dependencies FROM im JOIN edges e ON e.source = im.by AND e.kind IN ('reads','calls') GROUP BY im.id),
 pt AS (SELECT *, CASE WHEN properties > 15 THEN 3 WHEN properties > 8 THEN 2 WHEN properties > 5 THEN 1 ELSE 0 END + CASE WHEN invalidation > 5 THEN 3 WHEN invalidation > 3 THEN 2 WHEN invalidation > 1 THEN 1 ELSE 0 END + CASE WHEN depth > 5 THEN 2 WHEN depth > 3 THEN 1 ELSE 0 END AS points FROM mt)
 SELECT id, properties, methods, coalesce(dependencies, 0) AS dependencies, invalidation, 0 AS init_labels, 0 AS extensions, children, depth, points, CASE WHEN points <= 2 THEN 'low' WHEN points <= 5 THEN 'medium' WHEN points <= 8 THEN 'high' ELSE 'critical' END AS severity FROM pt LEFT JOIN dq USING (id)"""),
    "smells_all": (lambda s, d: health.smells(G(s, d)), GRAPH_SQL + SMELL_SQL + " SELECT * FROM sm"),
    "smells_by_severity": (lambda s, d: health.smells(G(s, d)).groupBy("severity").agg(F.count("*").alias("n")), GRAPH_SQL + SMELL_SQL + " SELECT severity, count(*) AS n FROM sm GROUP BY severity"),
    "contains_depth": (lambda s, d: health.containment_depth(G(s, d), G(s, d).nodes.select("id")), GRAPH_SQL + ", dn(root, id, depth) AS (SELECT id, id, 0 FROM nodes UNION SELECT root, e.target, depth + 1 FROM dn JOIN edges e ON e.source = dn.id AND e.kind = 'contains') SELECT root, max(depth) AS depth FROM dn GROUP BY root"),
    "arch_layers": (lambda s, d: health.node_layers(G(s, d), LAYERS).groupBy("layer").agg(F.count("*").alias("n")), GRAPH_SQL + LAYER_SQL + " SELECT layer, count(*) AS n FROM ly WHERE layer IS NOT NULL GROUP BY layer"),
    "arch_violations": (lambda s, d: health.violations(G(s, d), LAYERS, DENY), GRAPH_SQL + LAYER_SQL + " SELECT source, target, kind, a.layer AS from_layer, b.layer AS to_layer, CASE a.layer WHEN 'core' THEN 'orders must not touch the catalog' WHEN 'ui' THEN CASE b.layer WHEN 'supply' THEN 'ask the orders' END END AS reason, confidence FROM edges e JOIN ly a ON a.id = source JOIN ly b ON b.id = target WHERE kind IN ('calls','uses','type_ref','implements','inherits') AND (a.layer = 'core' AND b.layer = 'infra' OR a.layer = 'ui' AND b.layer IN ('core', 'supply') OR a.layer = 'supply' AND b.layer = 'places')"),
    "doctor_checks": (lambda s, d: health.doctor(G(s, d)).groupBy("check", "severity").agg(F.count("*").alias("n")), GRAPH_SQL + " SELECT 'orphan_edge' AS \"check\", 'error' AS severity, count(*) AS n FROM edges WHERE kind = 'uses' UNION ALL SELECT 'orphan_entity', 'info', count(*) FROM nodes WHERE kind = 'property'"),
    "infer_modules": (lambda s, d: health.infer_modules(G(s, d)), GRAPH_SQL + " SELECT coalesce(module, '(unknown)') AS module, printf('%s: %d symbols in %d files', coalesce(module, '(unknown)'), count(*), count(DISTINCT file)) AS summary, CAST(0.55 AS DOUBLE) AS confidence FROM nodes GROUP BY module"),
    "infer_ownership": (lambda s, d: health.infer_ownership(G(s, d)), GRAPH_SQL + " SELECT DISTINCT file, regexp_extract(file, '([^/]+)/[^/]*$', 1) AS owner, CAST(0.45 AS DOUBLE) AS confidence FROM nodes"),
    "filter_kinds": (lambda s, d: G(s, d).filter_kinds("fn,struct").edges.groupBy("kind").agg(F.count("*").alias("n")), GRAPH_SQL + ", k AS (SELECT id FROM nodes WHERE kind IN ('function', 'struct')) SELECT kind, count(*) AS n FROM edges WHERE source IN (FROM k) AND target IN (FROM k) GROUP BY kind"),
    "prune": (lambda s, d: G(s, d).prune().edges.groupBy("kind").agg(F.count("*").alias("n")), GRAPH_SQL + " SELECT kind, count(*) AS n FROM edges WHERE target IN (SELECT id FROM nodes) GROUP BY kind"),
    "select_nodes": (lambda s, d: G(s, d).select_nodes(kind="property", role="terminal", metadata_key="swiftui.invalidation_source").select("id", "name"), GRAPH_SQL + " SELECT id, name FROM nodes WHERE kind = 'property' AND invalidation"),
    "select_edges": (lambda s, d: G(s, d).select_edges(kind="uses", external_only=True).select("source", "target"), GRAPH_SQL + " SELECT source, target FROM edges WHERE kind = 'uses'"),
    "normalize_edges": (lambda s, d: G(s, d).normalise().edges.select("source", "target", "kind", F.coalesce("direction", F.lit("")).alias("direction"), "confidence", F.size("provenance").alias("spots")), GRAPH_SQL + " SELECT source, target, kind, coalesce(direction, '') AS direction, max(confidence) AS confidence, count(DISTINCT spot) AS spots FROM edges GROUP BY source, target, kind, coalesce(direction, ''), coalesce(condition, ''), coalesce(CAST(async_boundary AS VARCHAR), '')"),
    "normalize_nodes": (lambda s, d: (lambda g: type(g)(g.nodes.unionByName(g.nodes.where("kind = 'struct'").withColumns({"kind": F.lit("class"), "visibility": F.lit("crate"), "file": F.lit("zz.rs")})), g.edges).normalise().nodes.select("id", "kind", "file", "visibility"))(G(s, d)), GRAPH_SQL + " SELECT id, CASE kind WHEN 'struct' THEN 'class' ELSE kind END AS kind, file, CASE WHEN kind = 'struct' AND visibility = 'private' THEN 'crate' ELSE visibility END AS visibility FROM nodes"),
    "graph_delta": (_delta, DELTA_SQL),
    "delta_stats": (lambda s, d: _delta(s, d).groupBy("item", "change_type").agg(F.count("*").alias("n")), f"SELECT item, change_type, count(*) AS n FROM ({DELTA_SQL}) GROUP BY ALL"),
    "compact_group": (lambda s, d: G(s, d).compact().select("id", "relation", F.array_join("names", ",").alias("names")), GRAPH_SQL + " SELECT source AS id, CASE e.kind WHEN 'contains' THEN 'members' ELSE e.kind END AS relation, string_agg(n.name, ',' ORDER BY n.name) AS names FROM edges e JOIN nodes n ON n.id = e.target WHERE e.kind NOT IN ('uses', 'returns') GROUP BY source, e.kind"),
    "changed_symbols": (lambda s, d: records.changed_symbols(G(s, d), _hunks(s, d)), GRAPH_SQL + """, h AS (SELECT DISTINCT 'catalog/' || p_type || '.rs' AS file, unnest(range(p_partkey * 10 + 5, p_partkey * 10 + 13)) AS line FROM part
 UNION SELECT 'orders/lines.rs', unnest(range(l_orderkey * 10 + l_linenumber + 1, l_orderkey * 10 + l_linenumber + 3)) FROM lineitem),
 li AS (SELECT id, file, unnest(range(start_line, start_line + 10)) AS line FROM nodes UNION ALL SELECT source, 'orders/lines.rs', spot FROM edges WHERE spot IS NOT NULL AND source IN (SELECT id FROM nodes))
 SELECT DISTINCT id FROM li JOIN h USING (file, line)"""),
    "tokenize_terms": (lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.array_join(search_terms(F.coalesce("source", F.lit("")), F.coalesce("text", F.lit(""))), " ").alias("terms")), TERMS_SQL + " SELECT doc_id, array_to_string(terms, ' ') AS terms FROM tk"),
    "search_bm25": (lambda s, d: bm25(corpus(s, d).any_terms(QUERY)), BM25_SQL.format(terms=IN) + " SELECT id, round(score, 6) AS score, matched FROM bm"),
    "search_all_terms": (lambda s, d: bm25(corpus(s, d).all_terms(QUERY)), BM25_SQL.format(terms=IN) + " SELECT id, round(score, 6) AS score, matched FROM bm WHERE matched >= 5"),
    "search_relaxed": (lambda s, d: bm25(corpus(s, d).relaxed(QUERY)), BM25_SQL.format(terms=IN) + " SELECT id, round(score, 6) AS score, matched FROM bm WHERE matched >= 4"),
    "search_fuzzy": (lambda s, d: search.fuzzy(G(s, d).nodes, "od_99").select("id", "name"), GRAPH_SQL + " SELECT id, name FROM nodes WHERE regexp_matches(lower(name), 'o.*d.*9.*9')"),
    "search_filters": (lambda s, d: search.filtered(G(s, d).nodes, kind="function", public_only=True, file="orders/y199*.rs").select("id"), GRAPH_SQL + " SELECT id FROM nodes WHERE kind = 'function' AND visibility = 'public' AND file LIKE 'orders/y199%.rs'"),
    "cluster_bands": (lambda s, d: records.band_summary(bands(s, d)).select("band", "total"), BM25_SQL.format(terms=IN) + ", nb AS (SELECT round(score, 6) / max(round(score, 6)) OVER () AS v FROM bm) SELECT CASE WHEN v >= 0.85 THEN 'excellent' WHEN v >= 0.65 THEN 'strong' WHEN v >= 0.40 THEN 'possible' ELSE 'weak' END AS band, count(*) AS total FROM nb GROUP BY 1"),
    "fallback_rank": (lambda s, d: records.fallback_scores(s.read.parquet(f"{d}/nation.parquet").select("n_nationkey", "n_regionkey"), "n_nationkey", "n_regionkey"), "SELECT n_nationkey, n_regionkey, 0.55 - 0.20 * percent_rank() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS score FROM nation"),
    "history_list": (_history, "SELECT CAST(event_id AS VARCHAR) AS id, event_type AS kind, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, 'u' || user_id AS modules FROM events WHERE event_type = 'error'"),
    "annotations_latest": (_annotations, "SELECT CAST(user_id AS VARCHAR) AS symbol_key, arg_max(event_type, event_id) AS text, CAST(max(event_id) AS VARCHAR) AS updated_at FROM events GROUP BY user_id"),
    "link_drop_reasons": (_link, None),
    "link_edges": (_linked, None),
    "watch_sessions": (_bursts, "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), b AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM g), c AS (SELECT user_id, b, count(*) AS n FROM b GROUP BY ALL) SELECT user_id AS key, count(*) AS bursts, max(n) AS largest FROM c GROUP BY user_id"),
}
