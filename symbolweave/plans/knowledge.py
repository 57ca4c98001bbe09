"""Queries of search over nodes, strings, concepts, origins, manifests, annotations and changes with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from symbolweave import schema as S
from symbolweave.graph import CodeGraph
from symbolweave.operators import concepts, health, localization, origin, records, search, structure
from symbolweave.plans.structure import BM25_SQL, IN, SMELL_SQL, bands, nodes_index
from symbolweave.projection import GRAPH_SQL, stored_graph
from symbolweave.runtime import shared_dir
from symbolweave.streaming.feed import maintain

G = stored_graph

# -- search over nodes
WORDS = "list_filter(string_split(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '' AND length(x) < 40)"
SPLIT = "regexp_replace(" * 6 + "concat_ws(' ', n.name, locator, file)" + "".join(f", '{p}', '\\1 \\2', 'g')" for p in ("([a-z])([A-Z])", "([A-Za-z])([0-9])", "([0-9])([A-Za-z])") for _ in range(2))
NODE_SQL = GRAPH_SQL + f""", pa AS (SELECT target AS id, min(source) AS parent FROM edges WHERE kind = 'contains' GROUP BY target), ch(id, spot, owners) AS (SELECT id, id, CAST([] AS VARCHAR[]) FROM nodes UNION ALL SELECT ch.id, pa.parent, list_prepend(n.name, owners) FROM ch JOIN pa ON pa.id = ch.spot JOIN nodes n ON n.id = pa.parent),
lg AS (SELECT id, arg_max(owners, len(owners)) AS owners FROM ch GROUP BY id), lo AS (SELECT n.id, concat_ws('::', n.module, regexp_extract(file, '[^/]*$', 0), nullif(array_to_string(owners, '::'), ''), name) AS locator FROM nodes n JOIN lg USING (id)),
tk AS (SELECT id, 'name' AS f, {WORDS.format('name')} AS t FROM nodes UNION ALL SELECT id, 'file', {WORDS.format('file')} FROM nodes UNION ALL SELECT id, 'locator', {WORDS.format('locator')} FROM lo UNION ALL SELECT id, 'name_lower', [lower(name)] FROM nodes
 UNION ALL SELECT n.id, 'terms', list_distinct({WORDS.format(SPLIT).replace(' AND length(x) < 40', '')}) FROM nodes n JOIN lo USING (id)),
st AS (SELECT f, count(*) AS n, avg(len(t)) AS al FROM tk GROUP BY f), po AS (SELECT id, f, len, term, count(*) AS tf FROM (SELECT id, f, len(t) AS len, unnest(t) AS term FROM tk) GROUP BY ALL), dq AS (SELECT f, term, count(*) AS df FROM po GROUP BY f, term),
sc AS (SELECT id, f, term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / al)) AS s FROM po JOIN dq USING (f, term) JOIN st USING (f))"""


def _terms(words):
    return ", ".join(f"'{w}'" for w in words)


IDENTIFIER, PHRASE, LOCATOR = "order_1", "customer building 99", "AMERICA::order"
IDENTIFIER_SQL = NODE_SQL + f""", hit AS (SELECT id, s FROM sc WHERE f IN ('name', 'locator', 'file') AND term IN ({_terms(search.query_plain_terms(IDENTIFIER))}) UNION ALL SELECT id, 20 * s FROM sc WHERE f = 'name_lower' AND term = '{IDENTIFIER}'
 UNION ALL SELECT id, sum(s) FROM sc WHERE f = 'terms' AND term IN ({_terms(search.query_terms(IDENTIFIER))}) GROUP BY id HAVING count(*) = {len(search.query_terms(IDENTIFIER))}), sm AS (SELECT id, sum(s) AS score FROM hit GROUP BY id)"""
PHRASE_SQL = NODE_SQL + f""", hit AS (SELECT id, s FROM sc WHERE f IN ('name', 'locator', 'file') AND term IN ({_terms(search.query_plain_terms(PHRASE))})
 UNION ALL SELECT id, 2 * sum(s) FROM sc WHERE f = 'terms' AND term IN ({_terms(search.query_terms(PHRASE))}) GROUP BY id HAVING count(*) = 3 UNION ALL SELECT id, 1.5 * sum(s) FROM sc WHERE f = 'terms' AND term IN ({_terms(search.query_terms(PHRASE))}) GROUP BY id HAVING count(*) >= 2),
 sm AS (SELECT id, sum(s) AS score FROM hit GROUP BY id)"""
LOCATOR_SQL = NODE_SQL + f", sm AS (SELECT id, sum(s) AS score FROM sc WHERE f = 'locator' AND term IN ({_terms(search.query_plain_terms(LOCATOR))}) GROUP BY id HAVING count(*) = 2)"


def _found(s, d, query):
    return search.search(nodes_index(s, d), query).select("id", F.round("score", 6).alias("score"))


def _exact(s, d):
    index = nodes_index(s, d)
    best = search.top(search.search(index, IDENTIFIER).withColumn("score", F.round("score", 6)))
    return search.ranked(best.join(index.docs.select("id", "name", "kind", "locator"), "id"), IDENTIFIER).select("place", "id", "name", "score")


# -- strings: how orders show their priorities
CATALOG = [
    ("L", "1-URGENT", "Urgent", "orders/L.strings", "orders/"), ("L", "1-URGENT", "Urgent", "crm/L.strings", "crm/"), ("L", "2-HIGH", "High", "orders/L.strings", "orders/"),
    ("M", "O", "Open", "orders/M.strings", "orders/"), ("L", "not_specified", "None given", "orders/L.strings", "orders/"), ("L", "low_text", "Low", "crm/L.strings", "crm/"),
]


def string_tables(s, d):
    """(usages, catalog, wrappers, edges): every order uses a string in one of the ways that there are; customers call the wrapper or its getter."""
    orders = s.read.parquet(f"{d}/orders.parquet")
    p = F.col("o_orderpriority")
    shown = F.when(p.isin("1-URGENT", "2-HIGH"), p)
    usages = orders.select(
        F.concat(F.lit("o:"), F.col("o_orderkey").cast("string")).alias("id"), F.concat(F.lit("orders/y"), F.year("o_orderdate").cast("string"), F.lit(".rs")).alias("file"),
        F.when(shown.isNotNull(), "L").alias("table"), shown.alias("key"), F.when(p == "3-MEDIUM", F.col("o_orderstatus")).alias("literal"),
        F.when(p == "4-NOT SPECIFIED", "notSpecified").when(p == "5-LOW", "orderLowTexts").alias("wrapper_name"),
    )
    catalog = s.createDataFrame(CATALOG, ", ".join(f"`{c}` string" for c in localization.RECORD))
    wrappers = s.createDataFrame([("w:low", "orderLowText", "L", "low_text"), ("w:other", "lowOrderText", "L", "nothing")], "wrapper_id string, wrapper_name string, `table` string, key string")
    edge = lambda df, source, target, kind: df.select(source.alias("source"), F.lit(target).alias("target"), F.lit(kind).alias("kind"))
    customers = s.read.parquet(f"{d}/customer.parquet").withColumn("id", F.concat(F.lit("c:"), F.col("c_custkey").cast("string")))
    edges = edge(orders.where("o_orderpriority = '2-HIGH' AND o_custkey % 2 = 1"), F.concat(F.lit("o:"), F.col("o_orderkey").cast("string")), "w:low", "type_ref")
    edges = edges.unionByName(edge(customers.where("c_acctbal < 0"), F.col("id"), "w:low", "calls")).unionByName(edge(customers.where("c_acctbal > 9000"), F.col("id"), "g:low", "uses"))
    return usages, catalog, wrappers, edges.unionByName(edge(s.range(1), F.lit("g:low"), "w:low", "implements")).unionByName(edge(s.range(1), F.lit("g:low"), "w:low", "calls"))


def _resolve(s, d):
    usages, catalog, wrappers, edges = string_tables(s, d)
    refs = edges.where("kind = 'type_ref'").select(F.col("source").alias("id"), F.col("target").alias("wrapper_id"))
    return localization.resolve_usages(usages, catalog, wrappers, refs).drop("file")


def _used(s, d):
    usages, catalog, wrappers, edges = string_tables(s, d)
    return localization.l10n_usages(G(s, d).nodes, edges, usages, catalog, wrappers, "LOW")


RESOLVE_SQL = """WITH us AS (SELECT 'o:' || o_orderkey AS id, o_orderpriority AS p, o_orderstatus AS s, o_custkey FROM orders), rs AS (
SELECT id, 'orders/L.strings' AS catalog_file, 'L' AS "table", p AS key, CAST(NULL AS VARCHAR) AS wrapper_id, 'direct_metadata' AS match_kind FROM us WHERE p IN ('1-URGENT', '2-HIGH')
UNION ALL SELECT id, 'orders/M.strings', 'M', 'O', NULL, 'literal_key' FROM us WHERE p = '3-MEDIUM' AND s = 'O' UNION ALL SELECT id, NULL, NULL, NULL, NULL, 'unmatched' FROM us WHERE p = '3-MEDIUM' AND s <> 'O'
UNION ALL SELECT id, 'orders/L.strings', 'L', 'not_specified', NULL, 'wrapper_name_key' FROM us WHERE p = '4-NOT SPECIFIED' UNION ALL SELECT id, 'crm/L.strings', 'L', 'low_text', 'w:low', 'wrapper_name_approximate' FROM us WHERE p = '5-LOW'
UNION ALL SELECT id, 'crm/L.strings', 'L', 'low_text', 'w:low', 'wrapper_symbol' FROM us WHERE p = '2-HIGH' AND o_custkey % 2 = 1)"""


# -- concepts
def _concept(s, d):
    """Customers by segment as a value, some as a key too, open orders by a key, suppliers by an asset with a slip."""
    t = {n: s.read.parquet(f"{d}/{n}.parquet") for n in ("customer", "orders", "supplier")}
    row = lambda df, prefix, key, arm, text: df.select(F.concat(F.lit(prefix + ":"), F.col(key).cast("string")).alias("id"), F.lit(arm).alias("arm"), text.alias("text"))
    sources = row(t["customer"], "c", "c_custkey", "value", F.concat(F.lit("The "), F.lower("c_mktsegment")))
    sources = sources.unionByName(row(t["customer"].where("c_acctbal > 5000"), "c", "c_custkey", "key", F.concat(F.lit("segment"), F.initcap("c_mktsegment"), F.lit("Label"))))
    sources = sources.unionByName(row(t["orders"].where("o_orderstatus = 'P'"), "o", "o_orderkey", "key", F.lit("Building"))).unionByName(row(t["supplier"], "s", "s_suppkey", "asset", F.lit("buildng")))
    return concepts.concept_search(G(s, d), "building", sources, limit=None).drop("status")


CONCEPT_SQL = """WITH ev AS (SELECT 'c:' || c_custkey AS id, 880 AS s, 'v' AS w FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 'c:' || c_custkey, 800, 'k' FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000
 UNION ALL SELECT DISTINCT 'c:' || o_custkey, 840, 'o' FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 's:' || s_suppkey, 700, 'a' FROM supplier),
 nm AS (SELECT 'c:' || c_custkey AS id, c_name AS name, 'crm/' || c_mktsegment || '.rs' AS file FROM customer UNION ALL SELECT 's:' || s_suppkey, s_name, 'supply/' || n_name || '.rs' FROM supplier JOIN nation ON s_nationkey = n_nationkey)
 SELECT id, name, file, CAST(max(s) + 5 * (count(DISTINCT w) - 1) AS INTEGER) AS score, count(DISTINCT w) AS evidence FROM ev JOIN nm USING (id) GROUP BY ALL"""


# -- manifests, comments, annotations, assets
def _manifest(s, d):
    part = s.read.parquet(f"{d}/part.parquet").select("p_brand", F.split("p_type", " ")[0].alias("word")).distinct()
    kind = F.when(F.col("word") == "PROMO", "dev").when(F.col("word") == "SMALL", "build").when(F.col("word") == "LARGE", None).otherwise("normal")
    dep = F.concat_ws("::", "p_brand", F.lit("cargo_dependency"), F.coalesce(kind, F.lit("workspace")), "word")
    meta = lambda *kv: F.map_filter(F.create_map(*[x if not isinstance(x, str) else F.lit(x) for x in kv]), lambda k, v: v.isNotNull())
    empty = s.createDataFrame([], S.NODES)
    packages = part.select("p_brand").distinct().select(F.col("p_brand").alias("id"), F.lit("package").alias("kind"), F.col("p_brand").alias("name"), F.lit("Cargo.toml").alias("file"), meta("cargo.node", "package", "cargo.package.name", F.lower("p_brand")).alias("metadata"))
    deps = part.select(dep.alias("id"), F.lit("package").alias("kind"), F.col("word").alias("name"), F.concat("p_brand", F.lit("\\Cargo.toml")).alias("file"), meta("cargo.node", "dependency", "cargo.dependency.kind", kind, "cargo.dependency.package", F.when(F.col("word") == "MEDIUM", "medium-rs")).alias("metadata"))
    edges = s.createDataFrame([], S.EDGES).unionByName(part.select(F.col("p_brand").alias("source"), dep.alias("target"), F.lit("depends_on").alias("kind")), allowMissingColumns=True)
    return CodeGraph(empty.unionByName(packages, allowMissingColumns=True).unionByName(deps, allowMissingColumns=True), edges)


MANIFEST_SQL = """WITH pt AS (SELECT DISTINCT p_brand, split_part(p_type, ' ', 1) AS w FROM part), k AS (SELECT *, CASE w WHEN 'PROMO' THEN 'dev' WHEN 'SMALL' THEN 'build' WHEN 'LARGE' THEN 'workspace' ELSE 'normal' END AS kind FROM pt)
SELECT lower(p_brand) AS package, p_brand || '/Cargo.toml' AS manifest, w AS name, CASE w WHEN 'MEDIUM' THEN 'medium-rs' END AS package_name, CAST(NULL AS VARCHAR) AS version_req, 'registry' AS source, CAST(NULL AS VARCHAR) AS source_detail, kind, false AS inherited_workspace,
 p_brand AS package_id, p_brand || '::cargo_dependency::' || kind || '::' || w AS dependency_id, CAST(NULL AS VARCHAR) AS repo, row_number() OVER (ORDER BY p_brand || '/Cargo.toml', list_position(['normal', 'dev', 'build', 'workspace'], kind), w) AS place FROM k"""


def _documented(s, d):
    comment = F.concat(F.lit("/// "), "p_name", F.lit("\n///\n//! "), "p_type", F.lit("  \n"))
    part = s.read.parquet(f"{d}/part.parquet").select(F.concat(F.lit("p:"), F.col("p_partkey").cast("string")).alias("id"), F.when(F.col("p_size") > 5, comment).alias("doc_comment"))
    g = G(s, d)
    return health.infer_docs(CodeGraph(g.nodes.drop("doc_comment").join(part, "id", "left"), g.edges))


def _annotated(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    text = lambda c: F.col(c).cast("string")
    r = e.select(F.when(F.col("event_id") % 3 == 0, "").otherwise("p").alias("project_id"), F.when(F.col("event_id") % 2 == 0, "").otherwise("x").alias("branch"), F.when(F.col("event_id") % 5 == 0, "other").otherwise("").alias("repo"),
                 F.concat(F.lit("c:"), text("user_id")).alias("symbol_key"), F.concat("event_type", text("event_id")).alias("text"), text("event_id").alias("created_at"), text("event_id").alias("updated_at"))
    return records.annotation_for(G(s, d).nodes, r, "p")


ANNOTATED_SQL = """WITH r AS (SELECT 'c:' || user_id AS id, event_type || event_id AS text, event_id AS tm, event_id % 3 <> 0 AS mine, event_id % 2 = 0 AS shared, event_id % 5 <> 0 AS here, count(*) OVER (PARTITION BY user_id, event_id % 3 = 0) AS copies FROM events),
x AS (SELECT id, text, tm, CASE WHEN here AND mine AND shared THEN 1 WHEN here AND mine THEN 2 WHEN here AND shared THEN 3 WHEN here THEN 4 WHEN copies = 1 AND mine THEN 5 WHEN copies = 1 THEN 6 END AS rule FROM r WHERE id IN (SELECT 'c:' || c_custkey FROM customer))
SELECT id, arg_min(text, (rule, -tm)) AS text, CAST(min(rule) AS INTEGER) AS rule FROM x WHERE rule IS NOT NULL GROUP BY id"""


def _unused(s, d):
    part = s.read.parquet(f"{d}/part.parquet")
    name = F.concat_ws(" ", "p_brand", "p_name")
    named = F.create_map(F.lit("asset.ref_kind"), F.lit("image"), F.lit("asset.name"), name)
    nodes = part.select(F.col("p_partkey").cast("string").alias("id"), F.when(F.col("p_size") > 40, named).otherwise(F.create_map(F.lit("asset.name"), name)).alias("metadata"))
    return records.unused_assets(part.select(name.alias("name")).distinct(), nodes)


# -- changes
HUNKS = [("crm/BUILDING.rs", 0, 400), ("catalog/none.rs", 1, 2), ("orders/lines.rs", 10, 60)]
RISK_SQL = GRAPH_SQL + """, ch AS (SELECT id FROM nodes WHERE file = 'crm/BUILDING.rs' AND start_line <= 400 UNION SELECT source FROM edges WHERE spot BETWEEN 10 AND 60),
solid AS (SELECT id FROM nodes WHERE kind NOT IN ('view', 'branch')),
dep AS MATERIALIZED (SELECT DISTINCT e.target AS src, e.source AS dst FROM edges e WHERE kind IN ('calls','reads','implements','type_ref','inherits') AND source IN (FROM solid) AND target IN (FROM solid)),
walk(root, id, depth) AS (SELECT id, id, 0 FROM ch UNION SELECT source, target, 0 FROM edges WHERE kind = 'contains' AND source IN (SELECT ch.id FROM ch JOIN nodes USING (id) WHERE kind IN ('struct','class','enum','protocol','trait')) UNION SELECT root, dst, depth + 1 FROM walk JOIN dep ON src = walk.id WHERE depth < 3),
hit AS (SELECT root, id FROM walk GROUP BY ALL HAVING min(depth) > 0), n AS (SELECT (SELECT count(*) FROM ch) AS changed, (SELECT count(*) FROM hit) AS affected)
SELECT changed, affected, CASE WHEN affected > 20 THEN 'high' WHEN affected > 5 THEN 'medium' ELSE 'low' END AS risk FROM n"""
RULES = [("^p:.*7$", "network", "read", "fetch"), ("^p:", "persistence", "write", "save"), ("^o:1", "event", "pure", "next")]


def _stream(s, d):
    """The last order of each customer, pending ones deleted, folded from a stream of all orders."""
    path = f"{shared_dir(s)}/delta-{uuid.uuid4().hex}"
    schema = s.read.parquet(f"{d}/orders.parquet").schema
    source = s.readStream.schema(schema).option("pathGlobFilter", "orders.parquet").parquet(d)
    changes = source.select(F.col("o_custkey").cast("long").alias("key"), F.struct("o_orderdate", "o_orderkey").alias("ts"), F.col("o_orderkey").cast("long").alias("value"), F.when(F.col("o_orderstatus") == "P", "delete").otherwise("upsert").alias("op"))
    state = {"n": 0}
    s.createDataFrame([], "key long, value long").write.parquet(f"{path}/0")

    def store(df, epoch):
        # a new version beside the old: a batch that is run again starts from the same one
        df.write.mode("overwrite").parquet(f"{path}/{epoch + 1}")
        state["n"] = epoch + 1

    maintain(changes, lambda: s.read.schema("key long, value long").parquet(f"{path}/{state['n']}"), store, "key", f"{path}/checkpoint").awaitTermination()
    return s.read.schema("key long, value long").parquet(f"{path}/{state['n']}")


def _scoped(s, d):
    g = G(s, d)
    return health.smells(g, g.nodes.where("module = 'EUROPE'").select("id"))


FILES = ["crm/BUILDING.rs", "BUILDING.rs", "geo/ASIA", "supply\\CHINA.rs", "/root/project/geo/ASIA/mod.rs", "nowhere.rs"]
FILE_TESTS = ["file = 'crm/BUILDING.rs'", "file = 'crm/BUILDING.rs'", "starts_with(file, 'geo/ASIA')", "file = 'supply/CHINA.rs'", "file = 'geo/ASIA/mod.rs'", "false"]

QUERIES = {
    "search_identifier": (lambda s, d: _found(s, d, IDENTIFIER), IDENTIFIER_SQL + " SELECT id, round(score, 6) AS score FROM sm"),
    "search_phrase": (lambda s, d: _found(s, d, PHRASE), PHRASE_SQL + " SELECT id, round(score, 6) AS score FROM sm"),
    "search_locator": (lambda s, d: _found(s, d, LOCATOR), LOCATOR_SQL + " SELECT id, round(score, 6) AS score FROM sm"),
    "search_exact_rerank": (_exact, IDENTIFIER_SQL + """, best AS (SELECT id, round(score, 6) AS score FROM sm ORDER BY score DESC, id LIMIT 20)
 SELECT row_number() OVER (ORDER BY lower(name) <> 'order_1', CASE WHEN kind IN ('class', 'struct', 'module', 'protocol') THEN 0 WHEN kind = 'function' THEN 1 ELSE 2 END, score DESC, locator) AS place, id, name, score FROM best JOIN nodes USING (id) JOIN lo USING (id)"""),
    "l10n_resolve": (_resolve, RESOLVE_SQL + " SELECT * FROM rs"),
    "l10n_usages": (_used, RESOLVE_SQL + """ SELECT catalog_file, "table", key, id, match_kind FROM rs WHERE key = 'low_text' UNION ALL SELECT 'crm/L.strings', 'L', 'low_text', 'c:' || c_custkey, 'wrapper_caller' FROM customer WHERE c_acctbal < 0 OR c_acctbal > 9000"""),
    "concept_search": (_concept, CONCEPT_SQL),
    "origin_paths": (lambda s, d: origin.origins(G(s, d), "o:10"), None),
    "deps_report": (lambda s, d: structure.dependencies(_manifest(s, d)), MANIFEST_SQL),
    "infer_docs": (_documented, "SELECT 'p:' || p_partkey AS id, p_name || ' ' || p_type AS summary, CAST(0.70 AS DOUBLE) AS confidence FROM part WHERE p_size > 5"),
    "annotation_lookup": (_annotated, ANNOTATED_SQL),
    "assets_unused": (_unused, "SELECT DISTINCT p_brand || ' ' || p_name AS name FROM part WHERE p_brand || ' ' || p_name NOT IN (SELECT p_brand || ' ' || p_name FROM part WHERE p_size > 40)"),
    "change_risk": (lambda s, d: records.change_risk(G(s, d), s.createDataFrame(HUNKS, "file string, start_line int, end_line int")), RISK_SQL),
    "classify_rules": (lambda s, d: records.classify_calls(G(s, d).edges, RULES).select("source", "target", "terminal", "direction", "operation", "condition"), GRAPH_SQL + """ SELECT source, target, CASE WHEN target LIKE 'p:%7' THEN 'network' WHEN target LIKE 'p:%' THEN 'persistence' WHEN target LIKE 'o:1%' THEN 'event' END AS terminal,
 CASE WHEN target LIKE 'p:%7' THEN 'read' WHEN target LIKE 'p:%' THEN 'write' WHEN target LIKE 'o:1%' THEN 'pure' ELSE direction END AS direction, CASE WHEN target LIKE 'p:%7' THEN 'fetch' WHEN target LIKE 'p:%' THEN 'save' WHEN target LIKE 'o:1%' THEN 'next' END AS operation, condition FROM edges WHERE kind = 'calls'"""),
    "smells_module_scope": (_scoped, GRAPH_SQL + ", sp AS (SELECT id FROM nodes WHERE module = 'EUROPE'), near AS (SELECT * FROM edges WHERE source IN (FROM sp) OR target IN (FROM sp))" + SMELL_SQL.replace("edges", "near") + " SELECT * FROM sm WHERE id IN (FROM sp)"),
    "batch_file_symbols": (lambda s, d: structure.file_symbols(G(s, d), FILES), GRAPH_SQL + ", fq AS (" + " UNION ALL ".join(f"SELECT '{f}' AS query, id, name, kind, start_line, file FROM nodes WHERE {t}" for f, t in zip(FILES, FILE_TESTS, strict=True)) + ") SELECT * FROM fq"
                           + "".join(f" UNION ALL SELECT '{f}', NULL, NULL, NULL, NULL, NULL WHERE NOT EXISTS (FROM fq WHERE query = '{f}')" for f in FILES)),
    "cluster_page": (lambda s, d: records.band_page(bands(s, d), "id", 2, 10).select("id", "band", "place", F.round("normalised", 6).alias("normalised")), BM25_SQL.format(terms=IN) + """, nb AS (SELECT id, round(score, 6) / max(round(score, 6)) OVER () AS v FROM bm), bd AS (SELECT id, v, CASE WHEN v >= 0.85 THEN 'excellent' WHEN v >= 0.65 THEN 'strong' WHEN v >= 0.40 THEN 'possible' ELSE 'weak' END AS band FROM nb),
 pl AS (SELECT id, band, CAST(row_number() OVER (PARTITION BY band ORDER BY v DESC, id) AS INTEGER) AS place, round(v, 6) AS normalised FROM bd) SELECT * FROM pl WHERE place BETWEEN 11 AND 20"""),
    "stream_delta": (_stream, "WITH l AS (SELECT CAST(o_custkey AS BIGINT) AS key, CAST(o_orderkey AS BIGINT) AS value, o_orderstatus AS st, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) SELECT key, value FROM l WHERE r = 1 AND st <> 'P'"),
}
