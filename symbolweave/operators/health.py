"""Module summaries, complexity, smells, layering and integrity checks, inferred facts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symbolweave import schema as S
from symbolweave.functions.text import doc_summary, init_labels, layer_regex
from symbolweave.graph import CodeGraph
from symbolweave.operators.traverse import reach
from symbolweave.runtime import cut

UNKNOWN = "(unknown)"


def module_summary(graph: CodeGraph) -> DataFrame:
    """(module, symbol_count, file_count, edge_count, cross_module_edges, coupling_ratio, entry_points, terminals)."""
    n = graph.nodes.where(~F.col("kind").isin(S.STRUCTURAL)).withColumn("m", F.coalesce("module", F.lit(UNKNOWN)))
    role = lambda r: F.sum(F.coalesce(F.col("role_type") == r, F.lit(False)).cast("int"))
    own = n.groupBy("m").agg(F.count("*").alias("symbol_count"), F.countDistinct("file").alias("file_count"), role("entry_point").alias("entry_points"), role("terminal").alias("terminals"))
    e = graph.edges.join(n.select(F.col("id").alias("source"), "m"), "source").join(n.select(F.col("id").alias("target"), F.col("m").alias("to")), "target", "left")
    edges = e.groupBy("m").agg(F.count("*").alias("edge_count"), F.sum((F.col("to").isNotNull() & (F.col("to") != F.col("m"))).cast("int")).alias("cross_module_edges"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    ratio = F.when(F.col("edge_count") > 0, F.round(F.col("cross_module_edges") / F.col("edge_count"), 2)).otherwise(0.0)
    return own.join(edges, "m", "left").select(F.col("m").alias("module"), "symbol_count", "file_count", zero("edge_count"), zero("cross_module_edges"), F.coalesce(ratio, F.lit(0.0)).alias("coupling_ratio"), "entry_points", "terminals")


def module_kind_counts(graph: CodeGraph) -> DataFrame:
    """(module, kind, n): kind without underscores."""
    n = graph.nodes.where(~F.col("kind").isin(S.STRUCTURAL))
    return n.groupBy(F.coalesce("module", F.lit(UNKNOWN)).alias("module"), F.replace("kind", F.lit("_"), F.lit("")).alias("kind")).agg(F.count("*").alias("n"))


def containment_depth(graph: CodeGraph, roots: DataFrame) -> DataFrame:
    """(root, depth): steps of the longest chain of containment below each root.

    Leaves are peeled off: a node is as high as the number of rounds in which something below it is left, so a row a
    node is all that is kept. Nodes on or above a loop, which never come off, get the farthest of their shortest ways.
    """
    down = cut(graph.edges.where("kind = 'contains'").select(F.col("source").alias("src"), F.col("target").alias("dst")).distinct(), "depth-edges")
    heights, left, size = [], down, down.count()
    while size:
        owners = left.select("src").distinct()
        heights.append(owners)
        left = cut(left.join(owners.withColumnRenamed("src", "dst"), "dst", "left_semi").select("src", "dst"), "depth-edges")
        before, size = size, left.count()
        if size == before:
            break
    own = roots.select(F.col("id").alias("root")).distinct()
    if not heights:
        return own.withColumn("depth", F.lit(0))
    high = reduce(DataFrame.unionByName, heights).groupBy(F.col("src").alias("root")).agg(F.count("*").cast("int").alias("depth"))
    if size:
        looped = left.select(F.col("src").alias("root")).distinct()
        far = reach(down, own.join(looped, "root", "left_semi").select("root", F.col("root").alias("id"))).groupBy("root").agg(F.max("depth").alias("depth"))
        high = high.join(looped, "root", "left_anti").unionByName(far)
    return own.join(high, "root", "left").select("root", F.coalesce("depth", F.lit(0)).alias("depth"))


def _type_metrics(graph: CodeGraph) -> DataFrame:
    """(id, properties, methods, dependencies, invalidation, init_labels, extensions) of types, from what implements or refers to them."""
    n, e = graph.nodes, graph.edges
    types = n.where(F.col("kind").isin("struct", "class", "enum", "protocol", "trait")).select("id")
    imp = e.where("kind = 'implements'").select(F.col("target").alias("id"), F.col("source").alias("by")).distinct().join(types, "id", "left_semi")
    info = n.select(F.col("id").alias("by"), "kind", "name", (F.coalesce(F.try_element_at("metadata", F.lit("swiftui.invalidation_source")), F.lit("")) == "true").alias("flag"))
    one = lambda c: F.sum(c.cast("int"))
    a = imp.join(info, "by").groupBy("id").agg(one(F.col("kind").isin("property", "field")).alias("properties"), one(F.col("kind").isin("function", "method")).alias("methods"),
                                             one(F.col("flag")).alias("invalidation"), F.max(init_labels(F.col("name"))).alias("init_labels"))
    deps = imp.join(e.where("kind IN ('reads', 'calls')").select(F.col("source").alias("by"), "target", "kind"), "by").groupBy("id").agg(
        F.countDistinct("target").alias("dependencies"), F.countDistinct(F.when(F.col("kind") == "reads", F.col("target"))).alias("read_targets"))
    ext = e.where("kind = 'type_ref'").join(n.where("kind = 'extension'").select(F.col("id").alias("source")), "source", "left_semi").groupBy(F.col("target").alias("id")).agg(F.count("*").alias("extensions"))
    kids = e.where("kind = 'contains'").groupBy(F.col("source").alias("id")).agg(F.countDistinct("target").alias("children"))
    out = types.join(a, "id", "left").join(deps, "id", "left").join(ext, "id", "left").join(kids, "id", "left")
    return out.na.fill(0)


def complexity(graph: CodeGraph) -> DataFrame:
    """_type_metrics() with nesting depth, points and severity of every type."""
    m = _type_metrics(graph)
    m = m.join(containment_depth(graph, m.select("id")).withColumnRenamed("root", "id"), "id", "left").na.fill(0)

    def points(c, *steps):
        out = F.when(F.col(c) > steps[0][0], steps[0][1])
        for limit, p in steps[1:]:
            out = out.when(F.col(c) > limit, p)
        return out.otherwise(0)

    # Limits and points of each metric.
    score = reduce(lambda a, b: a + b, [points("properties", (15, 3), (8, 2), (5, 1)), points("invalidation", (5, 3), (3, 2), (1, 1)), points("init_labels", (8, 2), (5, 1)), points("extensions", (4, 2), (2, 1)), points("depth", (5, 2), (3, 1))])
    severity = F.when(score <= 2, "low").when(score <= 5, "medium").when(score <= 8, "high").otherwise("critical")
    return m.select("id", "properties", "methods", "dependencies", "invalidation", "init_labels", "extensions", "children", "depth", score.alias("points"), severity.alias("severity"))


# Metric, what it is called, and the limits of a warning and of a critical smell.
SMELLS = [("properties", "god_type", 15, 25), ("read_targets", "excessive_dependencies", 10, None), ("invalidation", "wide_invalidation", 5, 8), ("init_labels", "massive_init", 8, 12),
          ("depth", "deep_nesting", 5, None), ("extensions", "many_extensions", 5, None), ("fan_out", "high_fan_out", 15, None), ("fan_in", "high_fan_in", 15, None)]


def smells(graph: CodeGraph, scope: DataFrame | None = None) -> DataFrame:
    """(id, smell, metric, severity); scope (id): only edges that touch the scope count, only its symbols are reported."""
    if scope is not None:
        s = scope.select("id").distinct()
        touch = graph.edges.join(s, F.col("source") == F.col("id"), "left_semi").unionByName(graph.edges.join(s, F.col("source") == F.col("id"), "left_anti").join(s, F.col("target") == F.col("id"), "left_semi"))
        graph = CodeGraph(graph.nodes, touch, graph.version)
    m = _type_metrics(graph)
    m = m.join(containment_depth(graph, m.select("id")).withColumnRenamed("root", "id"), "id", "left").na.fill(0)
    funcs = graph.nodes.where("kind = 'function'").select("id")
    calls = graph.edges.where("kind = 'calls'")
    parts = [m]
    for end, name in (("source", "fan_out"), ("target", "fan_in")):
        parts.append(calls.groupBy(F.col(end).alias("id")).agg(F.count("*").alias(name)).where(f"{name} > 15").join(funcs, "id", "left_semi"))
    out = None
    for metric, smell, warn, critical in SMELLS:
        df = next(p for p in parts if metric in p.columns)
        severity = F.lit("warning") if critical is None else F.when(F.col(metric) > critical, "critical").otherwise("warning")
        part = df.where(F.col(metric) > warn).select("id", F.lit(smell).alias("smell"), F.col(metric).cast("long").alias("metric"), severity.alias("severity"))
        out = part if out is None else out.unionByName(part)
    return out if scope is None else out.join(s, "id", "left_semi")


def closure(graph: CodeGraph, roots: DataFrame) -> DataFrame:
    """(id): roots and all that they contain."""
    down = graph.edges.where("kind = 'contains'").select(F.col("source").alias("src"), F.col("target").alias("dst"))
    return reach(down, roots.select(F.col("id").alias("root"), "id")).select("id").distinct()


def node_layers(graph: CodeGraph, layers: list[tuple[str, list[str]]]) -> DataFrame:
    """(id, layer): the first layer one of whose patterns fits the node's module or file, whatever the case."""
    fits = lambda ps: reduce(lambda a, b: a | b, [F.lower(F.replace(c, F.lit("\\"), F.lit("/"))).rlike(layer_regex(p)) for p in ps for c in (F.coalesce("module", F.lit("")), F.col("file"))])
    layer = F.coalesce(*[F.when(fits(ps), F.lit(name)) for name, ps in layers if ps])
    return graph.nodes.select("id", "name", "file", layer.alias("layer")).where("layer IS NOT NULL")


def violations(graph: CodeGraph, layers: list[tuple[str, list[str]]], deny: list[tuple[str, str, str | None]]) -> DataFrame:
    """(source, target, kind, from_layer, to_layer, reason, confidence) of dependencies that deny rules forbid; a later rule replaces an equal one."""
    rules = {(a.lower(), b.lower()): r for a, b, r in deny}
    spark = graph.nodes.sparkSession
    rows = spark.createDataFrame([(a, b, r) for (a, b), r in rules.items()], "f string, t string, reason string")
    at = node_layers(graph, layers or [("", [])]) if layers else None
    if at is None or not rules:
        return graph.edges.limit(0).select("source", "target", "kind", F.lit("").alias("from_layer"), F.lit("").alias("to_layer"), F.lit("").alias("reason"), "confidence")
    e = graph.edges.where(F.col("kind").isin(S.ARCH)).select("source", "target", "kind", "confidence")
    e = e.join(at.select(F.col("id").alias("source"), F.col("layer").alias("from_layer")), "source").join(at.select(F.col("id").alias("target"), F.col("layer").alias("to_layer")), "target")
    return e.join(F.broadcast(rows), (F.lower("from_layer") == F.col("f")) & (F.lower("to_layer") == F.col("t"))).select("source", "target", "kind", "from_layer", "to_layer", "reason", "confidence")  # rules are a parameter


def doctor(graph: CodeGraph, inferred: DataFrame | None = None) -> DataFrame:
    """(check, severity, source, target): edges to nowhere, bad provenance, members without an owner, stale inferred links."""
    e, n = graph.edges, graph.nodes
    ids = n.select(F.col("id").alias("k"))
    lost = e.join(ids, F.col("source") == F.col("k"), "left_anti").unionByName(e.join(ids, F.col("source") == F.col("k"), "left_semi").join(ids, F.col("target") == F.col("k"), "left_anti"))
    kind = F.when(F.col("kind") == "contains", "missing_relation").otherwise("orphan_edge")
    out = lost.select(kind.alias("check"), F.lit("error").alias("severity"), "source", "target")
    p = e.select("source", "target", F.explode("provenance").alias("p"))
    wrong = (F.col("p.file") == "") | (F.col("p.start_line") > F.col("p.end_line"))
    named = F.col("p.symbol_id").isNotNull() & (F.col("p.symbol_id") != F.col("source")) & (F.col("p.symbol_id") != F.col("target"))
    strangers = p.where(~wrong & named).join(ids, F.col("p.symbol_id") == F.col("k"), "left_anti")
    out = out.unionByName(p.where(wrong).unionByName(strangers).select(F.lit("inconsistent_provenance").alias("check"), F.lit("warning").alias("severity"), "source", "target"))
    owned = e.where("kind = 'contains'").select(F.col("target").alias("k"))
    loose = n.where("kind IN ('field', 'property', 'variant')").join(owned, F.col("id") == F.col("k"), "left_anti")
    out = out.unionByName(loose.select(F.lit("orphan_entity").alias("check"), F.lit("info").alias("severity"), F.col("id").alias("source"), F.lit(None).cast("string").alias("target")))
    if inferred is not None:
        stale = inferred.join(ids, F.col("target_id") == F.col("k"), "left_anti")
        out = out.unionByName(stale.select(F.lit("stale_inferred_link").alias("check"), F.lit("warning").alias("severity"), F.col("target_id").alias("source"), F.lit(None).cast("string").alias("target")))
    return out


def infer_modules(graph: CodeGraph) -> DataFrame:
    s = module_summary(graph)
    return s.select("module", F.format_string("%s: %d symbols in %d files", "module", "symbol_count", "file_count").alias("summary"), F.lit(0.55).alias("confidence"))


def infer_ownership(graph: CodeGraph) -> DataFrame:
    """(file, owner, confidence): the last part of the path that is no src, dot or source file, else the module; of several the most confident, then the first by name."""
    n = graph.nodes.where(~F.col("kind").isin(S.STRUCTURAL))
    parts = F.filter(F.split(F.replace("file", F.lit("\\"), F.lit("/")), "/"), lambda p: ~p.isin("src", "", ".") & ~p.endswith(".rs") & ~p.endswith(".swift"))
    part = F.try_element_at(parts, F.lit(-1))
    module = F.when(~F.col("module").isin("", UNKNOWN), F.col("module"))
    rows = n.select("file", F.coalesce(part, module).alias("owner"), F.when(part.isNotNull(), 0.45).otherwise(0.35).alias("confidence")).where("owner IS NOT NULL")
    return rows.groupBy("file").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "owner")).alias("b")).select("file", "b.owner", (-F.col("b.c")).alias("confidence"))


def infer_docs(graph: CodeGraph) -> DataFrame:
    n = graph.nodes.where(~F.col("kind").isin(S.STRUCTURAL))
    return n.select("id", doc_summary(F.col("doc_comment")).alias("summary"), F.lit(0.70).alias("confidence")).where("summary <> ''")
