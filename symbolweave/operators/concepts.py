"""Business concepts: the symbols that a phrase names, by a store of confirmed concepts, catalogs, names and comments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symbolweave.functions.text import phrase, symbol_name
from symbolweave.graph import CodeGraph
from symbolweave.operators.search import SearchIndex, search, top
from symbolweave.runtime import cut, is_empty

# Base scores of arms: exact, contained, fuzzy. A symbol's name may also begin with the phrase.
ARMS = {"value": (920, 880, 850), "key": (840, 800, 780), "asset": (760, 720, 700)}
CONFIRMED, SYMBOL_EXACT, SYMBOL_PART, SYMBOL_NEAR, PRECISE, EVIDENCE = 1000, 660, 620, 560, 10, 5
# Kinds that a member is reported as.
SCOPES = ["class", "struct", "enum", "trait", "protocol", "impl", "extension", "view"]


def phrase_distance(n: Column) -> Column:
    return F.when(n <= 4, 1).when(n <= 12, 2).otherwise(3)


def token_distance(n: Column) -> Column:
    return F.when(n <= 3, 0).when(n <= 6, 1).otherwise(2)


def tokens_match(query: Column, value: Column) -> Column:
    """Every word of the phrase is near some word of the value: equal, or 1 or 2 edits away as its length allows."""
    words = lambda x: F.filter(F.split(x, " "), lambda w: w != "")
    near = lambda q, v: (q == v) | (F.levenshtein(q, v) <= token_distance(F.greatest(F.length(q), F.length(v))))
    return (F.size(words(query)) > 0) & F.forall(words(query), lambda q: F.exists(words(value), lambda v: near(q, v)))


def fuzzy_match(value: Column, query: Column) -> Column:
    """value and query, as phrases, are alike without one being in the value: a part the other way, few edits, or word by word."""
    n = F.greatest(F.length(value), F.length(query))
    part = (F.length(value) >= 4) & query.contains(value)
    alike = part | (F.levenshtein(query, value) <= phrase_distance(n)) | tokens_match(query, value)
    return (value != "") & (query != "") & ~value.contains(query) & alike


def match_score(value: Column, query: Column, exact: int, part: int, near: int) -> Column:
    return F.when(query == "", None).when(value == query, exact).when(value.contains(query), part).when(fuzzy_match(value, query), near)


def lifted(graph: CodeGraph) -> DataFrame:
    """(id, scope): what a symbol is reported as: members as their type, view or function, functions as their type or view, branches as what holds them."""
    n = graph.nodes.select("id", "kind")
    up = graph.edges.where("kind = 'contains'").groupBy(F.col("target").alias("at")).agg(F.min("source").alias("above"))
    up = cut(up.join(n.select(F.col("id").alias("above"), F.col("kind").alias("above_kind")), "above").select("at", "above", "above_kind"), "scope-up")
    member = F.col("kind").isin("property", "field", "variant")
    open_ = n.where(member | F.col("kind").isin("function", "branch")).select("id", "kind", F.col("id").alias("at"))
    found = None
    while True:
        step = cut(open_.join(up, "at"), "scope-step")
        passes = (F.col("above_kind") == "branch") | (member & (F.col("above_kind") == "module"))
        here = step.where(~passes).select("id", F.when((F.col("kind") == "function") & ~F.col("above_kind").isin(SCOPES), F.col("id")).otherwise(F.col("above")).alias("scope"))
        found = here if found is None else found.unionByName(here)
        open_ = step.where(passes & (F.col("above") != F.col("id"))).select("id", "kind", F.col("above").alias("at"))
        if is_empty(open_):
            return n.select("id").join(found, "id", "left").select("id", F.coalesce("scope", "id").alias("scope"))


def from_store(store: DataFrame, concept: str) -> DataFrame:
    """(concept, bindings): the record of store (concept, aliases, bindings) that the phrase names; if none exactly, the nearest."""
    names = store.select("concept", "bindings", F.explode(F.concat(F.array("concept"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name")).withColumn("name", phrase(F.col("name")))
    q = phrase(F.lit(concept))
    n, m = F.length("name"), F.length(q)
    part = ((m >= 4) & F.col("name").contains(q)) | ((n >= 4) & q.contains(F.col("name")))
    edits = F.levenshtein(q, F.col("name"))
    far = F.when(F.col("name") == q, -1).when(part, 0).when(edits <= phrase_distance(F.greatest(n, m)), edits)
    rows = names.where("name <> ''").select("concept", "bindings", far.alias("far"), F.abs(n - m).alias("gap")).where("far IS NOT NULL")
    return rows.orderBy("far", "gap", "concept").limit(1).select("concept", "bindings")


def concept_search(graph: CodeGraph, concept: str, sources: DataFrame, index: SearchIndex | None = None, store: DataFrame | None = None, limit: int | None = 20) -> DataFrame:
    """(id, name, file, score, status, evidence): symbols that a business phrase names, at most limit (None: all), best first.

    A confirmed concept's bindings come alone. Else sources (id, arm, text; arms value, key, asset), names and comments
    speak for a symbol's scope; a name's score falls with its place among the hits of index. The best score counts,
    and EVIDENCE points more for each further piece of evidence.
    """
    info = graph.nodes.select("id", "name", "file")
    if store is not None:
        bound = cut(from_store(store, concept).select(F.explode("bindings").alias("id")).distinct().join(info, "id"), "concept-bound")
        if not is_empty(bound):
            bound = bound.select("id", "name", "file", F.lit(CONFIRMED).alias("score"), F.lit("confirmed").alias("status"), F.lit(1).cast("long").alias("evidence")).orderBy("name", "file", "id")
            return bound if limit is None else bound.limit(limit)
    q = phrase(F.lit(concept))
    score = F.lit(None).cast("int")
    for arm, base in ARMS.items():
        score = F.when(F.col("arm") == arm, match_score(F.col("p"), q, *base)).otherwise(score)
    rows = sources.select("id", "arm", "text", phrase(F.col("text")).alias("p")).select("id", F.concat_ws(":", "arm", "text").alias("what"), score.alias("score"))
    docs = graph.nodes.where("doc_comment IS NOT NULL").select("id", F.concat(F.lit("doc:"), "id").alias("what"), match_score(phrase(F.col("doc_comment")), q, SYMBOL_NEAR + PRECISE, SYMBOL_NEAR + PRECISE, None).alias("score"))
    rows = rows.unionByName(docs)
    if index is not None:
        hits = top(search(index, concept), max(4 * (limit or 20), 8))
        place = hits.select("id", F.rank().over(_by_score()).alias("place"))
        name = phrase(symbol_name(F.col("name")))
        base = F.when(q == "", None).when(name == q, SYMBOL_EXACT).when(name.contains(q), SYMBOL_PART).when(tokens_match(q, name), SYMBOL_NEAR)
        named = graph.nodes.join(F.broadcast(place), "id")  # at most four pages
        rows = rows.unionByName(named.select("id", F.concat(F.lit("symbol:"), "id").alias("what"), F.greatest(base - F.col("place") + 1, F.lit(0)).alias("score")).where(base.isNotNull()))
    scoped = rows.where("score IS NOT NULL").join(lifted(graph), "id").groupBy("scope").agg(F.max("score").alias("best"), F.countDistinct("what").alias("evidence"))
    out = scoped.select(F.col("scope").alias("id"), (F.col("best") + EVIDENCE * (F.col("evidence") - 1)).cast("int").alias("score"), F.lit("candidate").alias("status"), "evidence").join(info, "id")
    out = out.select("id", "name", "file", "score", "status", "evidence").orderBy(F.desc("score"), "name", "file", "id")
    return out if limit is None else out.limit(limit)


def _by_score():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "id")  # at most four pages of hits
