"""Impact, forward and reverse traces, entry points and the derived dataflow graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symbolweave import schema as S
from symbolweave.functions.text import effect_component, is_accessor, symbol_name
from symbolweave.graph import CodeGraph
from symbolweave.operators.traverse import connected, reach, reach_in_order, ways
from symbolweave.runtime import cut, is_empty


def _ids(graph: CodeGraph, ids) -> DataFrame:
    """Ids given as a list or as a DataFrame with column id."""
    return ids.select("id") if isinstance(ids, DataFrame) else graph.nodes.sparkSession.createDataFrame([(i,) for i in ids], "id string")


def impact_seeds(graph: CodeGraph, ids) -> DataFrame:
    """(root, id): each root, and the direct members of a root that is a type."""
    roots = _ids(graph, ids).join(graph.nodes.select("id", "kind"), "id")
    members = graph.edges.where("kind = 'contains'").select(F.col("source").alias("root"), F.col("target").alias("id"))
    types = roots.where(F.col("kind").isin(S.SEEDED)).select(F.col("id").alias("root"))
    return roots.select(F.col("id").alias("root"), "id").unionByName(members.join(types, "root", "left_semi"))


def _dependents(graph: CodeGraph) -> DataFrame:
    """(src, dst): src is depended on by dst; nodes that don't exist, views and branches have no part."""
    solid = graph.nodes.where(~F.col("kind").isin(S.STRUCTURAL)).select("id")
    deps = graph.edges.where(F.col("kind").isin(S.IMPACT)).select(F.col("target").alias("src"), F.col("source").alias("dst"))
    return deps.join(solid.withColumnRenamed("id", "src"), "src", "left_semi").join(solid.withColumnRenamed("id", "dst"), "dst", "left_semi")


def _bucket() -> Column:
    return F.when(F.col("depth") >= 3, "depth3+").otherwise(F.concat(F.lit("depth"), F.col("depth").cast("string"))).alias("bucket")


def impact(graph: CodeGraph, ids, max_depth: int = 3, path: bool = False) -> DataFrame:
    """(root, id, name, kind, file, module, visibility, depth, bucket): what depends on each root, by fewest steps.

    Reverse edges of the impact kinds between nodes that exist and are no views or branches; a type's members are
    seeds too and are not reported. bucket: depth1, depth2, depth3+. path: a way from the seed to the dependent.
    """
    hit = reach(_dependents(graph), impact_seeds(graph, ids), max_depth, path)
    if path:
        hit = hit.join(ways(hit, hit.where("depth > 0")).select("root", "id", F.array_join("way", " > ").alias("path")), ["root", "id"])
    hit = hit.where("depth > 0")
    named = hit.join(graph.nodes.select("id", "name", "kind", "file", F.coalesce("module", F.lit("<unknown>")).alias("module"), "visibility"), "id")
    return named.select("root", "id", "name", "kind", "file", "module", "visibility", "depth", _bucket(), *(["path"] if path else []))


def impact_tree(graph: CodeGraph, ids, max_depth: int = 3, limit: int | None = None) -> DataFrame:
    """(root, id, bucket, depth, path, place, total, in_tree): impact() in the order of its queue, the first limit of each bucket.

    Dependents of one node come by name, file and id; of several nodes that lead to a dependent, the first met is its
    parent. path: ids from the seed on; place: its number in the bucket; total: the bucket's size before the limit.
    in_tree: the limit left all between the root and the dependent; what only leads to a member of a type is in no tree.
    """
    key = F.struct("name", F.coalesce("file", F.lit("")).alias("file"), "id")
    deps = _dependents(graph).join(graph.nodes.select(F.col("id").alias("dst"), key.alias("key")), "dst")
    # a root comes before its members
    first = F.struct(F.when(F.col("root") == F.col("id"), "0").otherwise("1").alias("name"), F.lit("").alias("file"), "id")
    hit = reach_in_order(deps, impact_seeds(graph, ids).withColumn("way", F.array(first)), max_depth).where("depth > 0")
    hit = hit.select("root", "id", _bucket(), "depth", "way")
    order = Window.partitionBy("root", "bucket").orderBy("depth", "way")
    kept = hit.withColumn("place", F.row_number().over(order))
    kept = cut(kept.where(F.col("place") <= limit) if limit is not None else kept, "impact-kept").withColumn("ids", F.col("way.id"))
    between = kept.select("root", F.col("id").alias("end"), F.explode(F.slice("ids", 2, F.size("ids") - 2)).alias("id"))
    lost = between.join(kept.select("root", "id"), ["root", "id"], "left_anti").select("root", F.col("end").alias("id"), F.lit(True).alias("lost")).distinct()
    out = kept.join(lost, ["root", "id"], "left").join(hit.groupBy("root", "bucket").agg(F.count("*").alias("total")), ["root", "bucket"])
    return out.select("root", "id", "bucket", "depth", F.array_join("ids", " > ").alias("path"), "place", "total",
                      (F.col("lost").isNull() & (F.element_at("ids", 1) == F.col("root"))).alias("in_tree"))


def impact_summary(found: DataFrame) -> DataFrame:
    """Totals for each root of impact()."""
    public = F.sum((F.col("visibility") == "public").cast("int"))
    return found.groupBy("root").agg(
        F.sum((F.col("depth") == 1).cast("int")).alias("direct"), F.count("*").alias("total"), F.countDistinct("file").alias("files"),
        F.countDistinct("module").alias("modules"), public.alias("public"), (F.count("*") - public).alias("internal"),
    )


def impact_top_modules(found: DataFrame, top: int = 5) -> DataFrame:
    return found.groupBy("module").agg(F.count("*").alias("affected")).orderBy(F.desc("affected"), "module").limit(top)


def accessor_clusters(graph: CodeGraph) -> DataFrame:
    """(id, cluster): getters and setters with the property that they implement; every other node is its own cluster."""
    pairs = graph.edges.where("kind = 'implements'").select("source", "target")
    n = graph.nodes.where("kind IN ('function', 'property')").select("id", "kind", symbol_name(F.col("name")).alias("base"), is_accessor(F.col("name")).alias("acc"))
    for end in ("source", "target"):
        pairs = pairs.join(n.select(*[F.col(c).alias(f"{end}_{c}") for c in n.columns]), F.col(end) == F.col(f"{end}_id"))
    way = lambda f, p: (F.col(f"{f}_kind") == "function") & F.col(f"{f}_acc") & (F.col(f"{p}_kind") == "property")
    links = cut(pairs.where((way("source", "target") | way("target", "source")) & (F.col("source_base") == F.col("target_base"))).select(F.col("source").alias("a"), F.col("target").alias("b")), "accessors")
    own = graph.nodes.select("id")
    if is_empty(links):
        return own.withColumn("cluster", F.col("id"))
    return own.join(connected(links), "id", "left").select("id", F.coalesce("component", "id").alias("cluster"))


def reverse_entries(graph: CodeGraph, target: str, max_depth: int | None = None) -> DataFrame:
    """(id, name, module, file, distance, path): entry points whose dataflow reaches target, over accessor clusters; those in its own cluster at distance 0.

    path: the clusters from the entry point to target, each the smallest id of those a step nearer to it.
    """
    cluster = cut(accessor_clusters(graph), "clusters")
    flow = graph.edges.where(F.col("kind").isin(S.DATAFLOW)).select("source", "target")
    flow = flow.join(cluster.select(F.col("id").alias("source"), F.col("cluster").alias("dst")), "source").join(cluster.select(F.col("id").alias("target"), F.col("cluster").alias("src")), "target")
    seeds = cluster.where(F.col("id") == target).select(F.lit(target).alias("root"), F.col("cluster").alias("id"))
    hit = reach(flow.where("src <> dst"), seeds, max_depth, parents=True)
    starts = cut(graph.nodes.where("role_type = 'entry_point'").select("id", "name", "module", "file").join(cluster, "id"), "entries")
    found = ways(hit, hit.join(starts.select(F.col("cluster").alias("id")), "id", "left_semi"))
    found = found.select(F.col("id").alias("cluster"), (F.size("way") - 1).alias("distance"), F.array_join(F.reverse("way"), " > ").alias("path"))
    return starts.join(found, "cluster").select("id", "name", "module", "file", "distance", "path")


def _direction(direction: Column, kind: Column) -> Column:
    return F.coalesce(direction, F.when(kind == "reads", "read").when(kind == "writes", "write").otherwise("unknown"))


def trace(graph: CodeGraph, entry: str, max_depth: int = 10) -> DataFrame:
    """Every way from entry along dataflow edges to the first terminal after it, at most max_depth steps.

    A pair of ends comes at most once in a way; parallel edges each make a way. Direction and operation are those of
    the terminal's first dataflow edge (by source, kind, direction, operation, condition), not of the edge walked.
    Columns: path (names), path_ids, hops, terminal_id, terminal_kind, direction, operation, conditions, asyncs.
    """
    flow = graph.edges.where(F.col("kind").isin(S.DATAFLOW))
    first = flow.groupBy("target").agg(F.min(F.struct("source", "kind", "direction", "operation", "condition")).alias("e"))
    ends = graph.nodes.where("role_type = 'terminal'").select(F.col("id").alias("at"), "terminal_kind")
    names = graph.nodes.select(F.col("id").alias("at"), "name")
    empty = F.array().cast("array<string>")
    root = graph.nodes.where(F.col("id") == entry).select(F.col("id").alias("at"), F.array("name").alias("names"), F.array("id").alias("ids"), empty.alias("pairs"), empty.alias("conditions"), empty.alias("asyncs"))
    steps = cut(flow.select(F.col("source").alias("from"), F.col("target").alias("to"), "condition", "async_boundary").join(names.select(F.col("at").alias("to"), "name"), "to", "left"), "flow")
    open_, found = cut(root, "trace"), []
    for _ in range(max_depth):
        pair = F.concat("from", F.lit(" -> "), "to")
        grown = open_.join(steps, F.col("at") == F.col("from")).where(~F.array_contains("pairs", pair))
        add = lambda a, when, x: F.when(when, F.array_append(a, x)).otherwise(F.col(a))
        grown = grown.select(F.col("to").alias("at"), F.array_append("names", F.coalesce("name", F.element_at(F.split("to", "::"), -1))).alias("names"), F.array_append("ids", F.col("to")).alias("ids"),
                             F.array_append("pairs", pair).alias("pairs"), add("conditions", F.col("condition").isNotNull(), F.col("condition")).alias("conditions"),
                             add("asyncs", F.coalesce("async_boundary", F.lit(False)), pair).alias("asyncs"))
        grown = cut(grown.join(ends, "at", "left"), "trace")
        if is_empty(grown):
            break
        found.append(grown.where("terminal_kind IS NOT NULL"))
        open_ = grown.where("terminal_kind IS NULL").drop("terminal_kind")
    if not found:
        found = [open_.withColumn("terminal_kind", F.lit(None).cast("string")).limit(0)]
    out = reduce(DataFrame.unionByName, found).join(first.withColumnRenamed("target", "at"), "at")
    return out.select(F.array_join("names", " > ").alias("path"), F.array_join("ids", " > ").alias("path_ids"), (F.size("ids") - 1).alias("hops"), F.col("at").alias("terminal_id"), "terminal_kind",
                      _direction(F.col("e.direction"), F.col("e.kind")).alias("direction"), F.col("e.operation").alias("operation"),
                      F.array_join("conditions", ",").alias("conditions"), F.size("asyncs").alias("asyncs"))


def trace_summary(flows: DataFrame) -> DataFrame:
    n = lambda test: F.coalesce(F.sum(test.cast("int")), F.lit(0)).cast("long")
    d = F.col("direction")
    return flows.agg(F.count("*").alias("flows"), n(d.isin("read", "read_write")).alias("reads"), n(d.isin("write", "read_write")).alias("writes"), F.coalesce(F.sum("asyncs"), F.lit(0)).cast("long").alias("async_crossings"))


# Starts of names that mark a function as an action.
ACTION = "^(on|handle|did|go)"


def fallback_roots(graph: CodeGraph, entry: str) -> DataFrame:
    """(id, name, rank): where a trace may start when entry itself leads nowhere: members, implementors and types referred to, of the same file."""
    mine = graph.nodes.where(F.col("id") == entry).select(F.col("file").alias("own_file"))
    e = graph.edges
    out_ = e.where(F.col("kind").isin("contains", "type_ref") & (F.col("source") == entry)).select(F.col("target").alias("id"))
    up = e.where((F.col("kind") == "implements") & (F.col("target") == entry)).select(F.col("source").alias("id"))
    found = graph.nodes.select("id", "name", "kind", "file").join(out_.union(up).distinct(), "id", "left_semi").join(F.broadcast(mine), F.col("file") == F.col("own_file"))  # one row
    starts = e.where(F.col("kind").isin(S.DATAFLOW)).join(found.select(F.col("id").alias("source")), "source", "left_semi").select(F.col("source").alias("id"), F.lit(True).alias("flows")).distinct()
    name = symbol_name(F.col("name"))
    rank = F.when(name == "body", 0).when((F.col("kind") == "function") & name.rlike(ACTION), 1).when(F.col("flows"), 2)
    return found.join(starts, "id", "left").select("id", "name", rank.alias("rank")).where("rank IS NOT NULL")


def is_test(file: Column, id_: Column) -> Column:
    tail = F.slice(F.split(id_, "::"), 2, F.greatest(F.size(F.split(id_, "::")) - 1, F.lit(1)))
    return file.rlike(r"(^|/)tests/|(^|/)tests\.rs$|_tests?\.rs$") | F.array_contains(tail, "tests")


def entries(graph: CodeGraph, module: str | None = None, file: str | None = None, tests: bool = False, limit: int | None = None) -> DataFrame:
    """(id, name, module, file, rank, total): entry points in order of rank, module, file, name, id; total counts them before the limit."""
    test = F.col("kind").isin("function", "method") & is_test(F.col("file"), F.col("id"))
    n = graph.nodes.where("role_type = 'entry_point'").where(test if tests else ~test)
    if module is not None:
        n = n.where(F.lower("module") == module.lower())
    if file is not None:
        n = n.where(F.col("file").contains(file))
    # Names that mark the main ways into a program.
    rank = F.when(F.col("name") == "main", 0).when(F.col("name").isin("run", "dispatch", "serve", "handle", "execute", "start"), 1).when(F.col("visibility") == "public", 2).otherwise(3)
    total = n.agg(F.count("*").alias("total"))
    out = n.select("id", "name", "module", "file", rank.alias("rank")).crossJoin(F.broadcast(total))  # one row
    out = out.orderBy("rank", F.coalesce("module", F.lit("")), "file", "name", "id")
    return out.limit(limit) if limit is not None else out


def dataflow(graph: CodeGraph, entry: str, max_depth: int = 10) -> DataFrame:
    """(source, target, kind, operation, conditions, async_boundary): the graph of calls and effects behind entry.

    Calls to what is no terminal go on; calls to terminals, reads, writes, publishes and subscribes end in an effect
    node effect::kind::target::operation. A direction overrides the kind; read_write makes a read and a write. Types
    give no rows.
    """
    start = graph.nodes.where((F.col("id") == entry) & ~F.col("kind").isin("class", "struct", "enum", "protocol", "extension")).select(F.col("id").alias("root"), "id")
    info = graph.nodes.select("id", "name", F.when(F.col("role_type") == "terminal", F.col("terminal_kind")).alias("end"))
    flow = graph.edges.where(F.col("kind").isin(S.DATAFLOW))
    flow = flow.join(info.select(F.col("id").alias("target"), F.col("name").alias("to_name"), F.col("end").alias("to_end"), F.lit(True).alias("there")), "target", "left")
    goes = (F.col("kind") == "calls") & F.col("there") & F.col("to_end").isNull()
    seen = reach(flow.where(goes).select(F.col("source").alias("src"), F.col("target").alias("dst")), start, max_depth)
    near = seen.where(F.col("depth") < max_depth).select(F.col("id").alias("source"))
    out = flow.join(near, "source").join(info.select(F.col("id").alias("source"), F.col("end").alias("from_end")), "source")
    # Names of effects by edge kind.
    label = F.create_map(*[F.lit(x) for p in (("calls", "call"), ("reads", "read"), ("writes", "write"), ("publishes", "publish"), ("subscribes", "subscribe")) for x in p])
    by_kind = F.array(F.element_at(label, F.col("kind")))
    kinds = (F.when(F.col("direction") == "read", F.array(F.lit("read"))).when(F.col("direction") == "write", F.array(F.lit("write")))
             .when(F.col("direction") == "read_write", F.array(F.lit("read"), F.lit("write"))).when(F.col("direction") == "pure", F.array(F.lit("call"))).otherwise(by_kind))
    op = F.nullif(F.trim(F.col("operation")), F.lit(""))
    effect = F.concat_ws("::", F.lit("effect"), F.coalesce("to_end", "from_end", F.element_at(label, F.col("kind"))), effect_component(F.coalesce("to_name", F.element_at(F.split("target", "::"), -1))), effect_component(F.coalesce(op, F.lit(""))))
    rows = out.select("source", F.when(goes, F.col("target")).otherwise(effect).alias("target"), F.explode(F.when(goes, F.array(F.lit("call"))).otherwise(kinds)).alias("kind"), op.alias("operation"), "condition", "async_boundary")
    return rows.groupBy("source", "target", "kind", "operation").agg(F.array_join(F.array_sort(F.collect_set("condition")), ",").alias("conditions"), F.coalesce(F.max("async_boundary"), F.lit(False)).alias("async_boundary"))


def dataflow_limited(edges: DataFrame, entry: str, limit: int) -> DataFrame:
    """(item, source, target, kind, operation, total): the first limit edges of dataflow() and the nodes at their ends.

    Edges by source, target, kind (call, read, write, publish, subscribe) and operation. A node has its id as source
    and the kind symbol or effect; entry always stays. total: how many there were of the item before the limit.
    """
    edges = cut(edges, "dataflow")
    rank = F.array_position(F.array(*[F.lit(k) for k in ("call", "read", "write", "publish", "subscribe")]), F.col("kind"))
    first = edges.orderBy("source", "target", rank, F.col("operation").asc_nulls_first()).limit(limit)
    start = edges.sparkSession.createDataFrame([(entry,)], "source string")
    ends = lambda df: df.select(F.explode(F.array("source", "target")).alias("source")).union(start).distinct()
    none = F.lit(None).cast("string")
    nodes = ends(first).select(F.lit("node").alias("item"), "source", none.alias("target"), F.when(F.col("source").startswith("effect::"), "effect").otherwise("symbol").alias("kind"), none.alias("operation"))
    out = first.select(F.lit("edge").alias("item"), "source", "target", "kind", "operation").unionByName(nodes)
    totals = edges.agg(F.count("*").alias("total")).select(F.lit("edge").alias("item"), "total").union(ends(edges).agg(F.count("*")).select(F.lit("node"), "count(1)"))
    return out.join(F.broadcast(totals), "item")  # two rows


def dataflow_summary(edges: DataFrame) -> DataFrame:
    kind = lambda k: F.coalesce(F.sum((F.col("kind") == k).cast("int")), F.lit(0)).cast("long")
    ends = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    counts = ends.agg(F.coalesce(F.sum((~F.col("id").startswith("effect::")).cast("int")), F.lit(0)).cast("long").alias("symbols"), F.coalesce(F.sum(F.col("id").startswith("effect::").cast("int")), F.lit(0)).cast("long").alias("effects"))
    totals = edges.agg(F.count("*").alias("edges"), *[kind(k).alias(n) for k, n in (("call", "calls"), ("read", "reads"), ("write", "writes"), ("publish", "publishes"), ("subscribe", "subscribes"))])
    return counts.crossJoin(totals)  # one row each
