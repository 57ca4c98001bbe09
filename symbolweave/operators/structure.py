"""Symbols and their surroundings: resolution, locators, context, usages, API surface, files, modules, dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symbolweave import schema as S
from symbolweave.functions.text import basename, dirname, is_accessor, symbol_name
from symbolweave.graph import CodeGraph
from symbolweave.operators.traverse import reach
from symbolweave.runtime import cut, is_empty


def locators(graph: CodeGraph) -> DataFrame:
    """(id, locator): module::file::owners::name, owners from the outermost in, each node's parent the first by span; a loop ends the chain."""
    n = graph.nodes.select("id", "name", "kind", "file", "module", "start_line", "end_line")
    up = graph.edges.where("kind = 'contains'").select(F.col("source").alias("parent"), F.col("target").alias("id"))
    order = Window.partitionBy("id").orderBy(F.col("kind").isin(S.STRUCTURAL), "start_line", "end_line", "parent")
    parent = up.join(n.select(F.col("id").alias("parent"), "kind", "start_line", "end_line", F.col("name").alias("owner")), "parent").join(n.select("id"), "id", "left_semi")
    parent = cut(parent.withColumn("r", F.row_number().over(order)).where("r = 1").select("id", "parent", "owner"), "parents")
    chain = cut(n.select("id", F.col("id").alias("at"), F.array("id").alias("seen"), F.array().cast("array<string>").alias("owners")), "chains")
    done = None
    while True:
        step = chain.join(parent.select(F.col("id").alias("at"), F.col("parent").alias("next"), "owner"), "at", "left")
        step = cut(step.withColumn("ends", F.col("next").isNull() | F.array_contains("seen", F.col("next"))), "chains")
        ended = step.where("ends").select("id", "owners")
        done = ended if done is None else done.unionByName(ended)
        chain = step.where("NOT ends").select("id", F.col("next").alias("at"), F.array_append("seen", F.col("next")).alias("seen"), F.array_prepend("owners", F.col("owner")).alias("owners"))
        if is_empty(chain):
            break
    file = basename(F.col("file"))
    module = F.when((F.col("module") != "") & (F.col("module") != file), F.col("module"))
    return n.join(done, "id").select("id", F.concat_ws("::", module, file, "owners", "name").alias("locator"))


# How kinds rank when equally good names compete.
PREFERENCE = {
    0: ["class", "struct", "enum", "trait", "module", "namespace", "type_alias", "protocol"],
    1: ["function", "method", "route"],
    2: ["property", "variable", "constant", "variant", "enum_member", "field", "parameter"],
    3: ["impl", "extension", "import", "export", "package"],
    4: ["file", "component", "view", "branch"],
}
# Endings of a file part of a query that need no slash.
SOURCE_ENDS = (".swift", ".rs")


def _tier(query: str):
    """0 id, 1 locator, 2 end of a locator (query with ::), 3 name, 4 start of a name, 5 end of an id, 6 name in any case."""
    name, base = symbol_name(F.col("name")), query.removeprefix("getter:").removeprefix("setter:").partition("(")[0]
    out = F.when(F.col("id") == query, 0).when(F.col("locator") == query, 1)
    if "::" in query:
        out = out.when(F.col("locator").endswith("::" + query), 2)
    return out.when(name == base, 3).when(name.startswith(base), 4).when(F.col("id").endswith(query), 5).when(F.lower(name) == base.lower(), 6)


def resolve(graph: CodeGraph, query: str, with_locators: DataFrame | None = None) -> DataFrame:
    """(id, name, kind, tier): the nodes that query names: one row is a hit, more are ambiguous, none is not found.

    The best tier counts, in it the best kind. file::symbol looks within files that end so, if nothing fits as a whole.
    """
    n = graph.nodes
    if "::" not in query:
        return _best(n.withColumn("locator", F.lit(None).cast("string")), _tier(query))
    n = n.join(with_locators if with_locators is not None else locators(graph), "id")
    found = _best(n, _tier(query))
    if not is_empty(found):
        return found
    file, _, rest = query.rpartition("::")
    if rest and file and ("/" in file or "\\" in file or file.endswith(SOURCE_ENDS)):
        n, query = n.where(F.col("file").endswith(file)), rest
    return _best(n, _tier(query))


def _best(nodes: DataFrame, tier) -> DataFrame:
    order = {k: i for i, ks in PREFERENCE.items() for k in ks}
    kind = F.try_element_at(F.create_map(*[F.lit(x) for p in order.items() for x in p]), F.col("kind"))
    hit = nodes.select("id", "name", "kind", tier.alias("tier"), kind.alias("preference")).where("tier IS NOT NULL")
    best = hit.agg(F.min(F.struct("tier", "preference")).alias("b"))
    return hit.crossJoin(F.broadcast(best)).where("tier = b.tier AND preference = b.preference").select("id", "name", "kind", "tier")  # one row


def context(graph: CodeGraph, symbol: str, limit: int | None = None) -> DataFrame:
    """(section, id, name, kind, file, total): the neighbourhood of a node; limit holds for each section, total counts before it.

    For types, edges that reach a direct member from elsewhere count for callers, read_by and implementors.
    """
    e, n = graph.edges, graph.nodes.select("id", "name", "kind", "file")
    me = graph.nodes.where(F.col("id") == symbol).select("id", "kind")
    members = e.where((F.col("kind") == "contains") & (F.col("source") == symbol)).select(F.col("target").alias("m")).distinct()
    members = members.join(me.where(F.col("kind").isin(S.SEEDED)).select(F.lit(1)), how="left_semi")
    out = None
    plan = [("callers", "calls", "in"), ("callees", "calls", "out"), ("reads", "reads", "out"), ("read_by", "reads", "in"), ("implements", "implements", "out"),
            ("implementors", "implements", "in"), ("type_refs", "type_ref", "out"), ("contains", "contains", "out"), ("contained_by", "contains", "in")]
    for section, kind, way in plan:
        near, far = ("target", "source") if way == "in" else ("source", "target")
        of_kind = e.where(F.col("kind") == kind)
        rows = of_kind.where(F.col(near) == symbol).select(F.col(far).alias("id"))
        if section in ("callers", "read_by", "implementors"):
            inner = of_kind.join(members, F.col("target") == F.col("m"), "left_semi").join(members, F.col("source") == F.col("m"), "left_anti")
            rows = rows.union(inner.where(F.col("source") != symbol).select("source")).distinct()
        part = rows.join(n, "id").select(F.lit(section).alias("section"), "id", "name", "kind", "file")
        out = part if out is None else out.unionByName(part)
    w = Window.partitionBy("section")
    out = out.withColumn("total", F.count("*").over(w))
    if limit is None:
        return out
    # what contains and is contained goes by its place in the file, all else by name
    spot = out.join(graph.nodes.select("id", *SPOT), "id").withColumns({c: F.when(F.col("section").isin("contains", "contained_by"), F.col(c)) for c in SPOT})
    return spot.withColumn("r", F.row_number().over(w.orderBy(*SPOT, "name", "file", "id"))).where(F.col("r") <= limit).select(*out.columns)


SPOT = ["start_line", "start_col", "end_line", "end_col"]


def contains_tree(graph: CodeGraph, symbol: str, limit: int | None = None) -> DataFrame:
    """(path, id, name, kind, depth, inline, start_line, start_col, end_line, end_col): all that symbol contains, a row for each way to it.

    Siblings go by start, end, name and id; limit leaves the first of the top level, with all below them. A view that
    refers to a property or function also shows what that contains (inline). No id comes twice in a way.
    """
    n = graph.nodes.select("id", "name", "kind", *SPOT)
    holds = graph.edges.where("kind = 'contains'").select(F.col("source").alias("src"), F.col("target").alias("dst"))
    views = graph.edges.where("kind = 'type_ref'").select(F.col("source").alias("view"), F.col("target").alias("id"))
    views = views.join(n.where("kind = 'view'").select(F.col("id").alias("view")), "view", "left_semi")
    shown = views.join(n.where("kind IN ('property', 'function')").select("id"), "id", "left_semi").join(holds, F.col("id") == F.col("src"))
    steps = holds.withColumn("inline", F.lit(False)).union(shown.select("view", "dst", F.lit(True)))
    steps = cut(steps.join(n.withColumnRenamed("id", "dst"), "dst"), "contains")
    top = steps.where((F.col("src") == symbol) & ~F.col("inline"))
    if limit is not None:
        top = top.orderBy(*SPOT, "name", "dst").limit(limit)
    columns = ["way", F.col("dst").alias("id"), "name", "kind", "inline", *SPOT]
    level = cut(top.withColumn("way", F.array("dst")).select(*columns), "tree")
    out, depth = level.withColumn("depth", F.lit(1)), 1
    while not is_empty(level):
        depth += 1
        grown = level.select("way", F.col("id").alias("src")).join(steps, "src").where(~F.array_contains("way", F.col("dst")))
        level = cut(grown.withColumn("way", F.array_append("way", F.col("dst"))).select(*columns), "tree")
        out = out.unionByName(level.withColumn("depth", F.lit(depth)))
    return out.select(F.array_join("way", " > ").alias("path"), "id", "name", "kind", "depth", "inline", *SPOT)


def batch_context(graph: CodeGraph, symbols: list[str], limit: int | None = None) -> DataFrame:
    """context() for each of at most 20 symbols, with the column query; a symbol that is no node gives one row with section not_found."""
    if len(symbols) > 20:
        raise ValueError("at most 20 symbols")
    out = None
    for s in dict.fromkeys(symbols):
        found = context(graph, s, limit).withColumn("query", F.lit(s))
        missing = graph.nodes.sparkSession.createDataFrame([(s,)], "id string").join(graph.nodes.select("id"), "id", "left_anti")
        found = found.unionByName(missing.select(F.lit("not_found").alias("section"), "id", F.lit(s).alias("query")), allowMissingColumns=True)
        out = found if out is None else out.unionByName(found)
    return out


def invalidation_sources(graph: CodeGraph, symbol: str) -> DataFrame:
    """(id, name): nodes flagged as invalidation sources that symbol reads, by any number of steps, itself included."""
    reads = graph.edges.where("kind = 'reads'").select(F.col("source").alias("src"), F.col("target").alias("dst"))
    hit = reach(reads, graph.nodes.where(F.col("id") == symbol).select(F.col("id").alias("root"), "id"))
    flagged = F.try_element_at("metadata", F.lit("swiftui.invalidation_source")) == "true"
    return graph.nodes.where(flagged).join(hit.select("id"), "id", "left_semi").select("id", "name")


def api_members(graph: CodeGraph, type_id: str, private: bool = False) -> DataFrame:
    """(id, name, kind, visibility, owner): the surface of a type: API members of it and of its extensions, and nodes named under its id.

    An extension or impl is the type's by an extends or type_ref edge, or by an equal name. owner is the first by id.
    """
    n, e = graph.nodes, graph.edges
    own = F.broadcast(n.where(F.col("id") == type_id).select(symbol_name(F.col("name")).alias("own")))  # one row
    ext = n.where("kind IN ('extension', 'impl')").select("id", symbol_name(F.col("name")).alias("base"))
    by_edge = e.where(F.col("kind").isin("extends", "type_ref") & (F.col("target") == type_id)).select(F.col("source").alias("id"))
    owners = ext.join(by_edge, "id", "left_semi").select("id").union(ext.join(own, F.col("base") == F.col("own"), "left_semi").select("id")).union(n.where(F.col("id") == type_id).select("id")).distinct()
    children = e.where("kind = 'contains'").join(owners.withColumnRenamed("id", "source"), "source", "left_semi").select(F.col("target").alias("id"), F.lit(0).alias("turn"), F.col("source").alias("owner"))
    named = F.col("id").startswith(type_id + "::")
    if type_id.startswith("s:"):
        named = (F.col("id").startswith(type_id) | F.col("id").startswith("s:e:" + type_id)) & (F.col("id") != type_id)
    implied = n.where(named).select("id", F.lit(1).alias("turn"), F.lit(type_id).alias("owner"))
    ids = children.unionByName(implied).groupBy("id").agg(F.min(F.struct("turn", "owner"))["owner"].alias("owner"))
    found = n.where(F.col("kind").isin(S.API) & ~is_accessor(F.col("name"))).join(ids, "id")
    return (found if private else found.where("visibility <> 'private'")).select("id", "name", "kind", "visibility", "owner")


def api_surface(graph: CodeGraph, type_id: str, private: bool = False) -> DataFrame:
    """api_members() and, as section referenced_types, what they refer to."""
    members = cut(api_members(graph, type_id, private), "api-members")
    refs = graph.edges.where(F.col("kind").isin("type_ref", "returns", "type_of")).join(members.select(F.col("id").alias("source")), "source", "left_semi")
    types = graph.nodes.join(refs.select(F.col("target").alias("id")), "id", "left_semi").select("id", "name", "kind", "visibility", F.lit(None).cast("string").alias("owner"))
    return members.withColumn("section", F.lit("members")).unionByName(types.withColumn("section", F.lit("referenced_types")))


def usages(graph: CodeGraph, symbol: str, exclude: list[str] = (), limit: int | None = None) -> DataFrame:
    """(target, source, name, file, kind, confidence, total): uses of a node, and of a type's members, from outside of them."""
    e, n = graph.edges, graph.nodes
    targets = n.where(F.col("id") == symbol).select("id", "kind")
    members = api_members(graph, symbol, True).select("id").join(targets.where(F.col("kind").isin(S.SEEDED)).select(F.lit(1)), how="left_semi")
    ids = cut(targets.select("id").union(members).distinct(), "usage-targets")
    used = e.where(F.col("kind").isin(S.USAGE)).join(ids.withColumnRenamed("id", "target"), "target", "left_semi").join(ids.withColumnRenamed("id", "source"), "source", "left_anti")
    found = used.select("target", "source", "kind", "confidence").join(n.select(F.col("id").alias("source"), "name", "file"), "source")
    for x in exclude:
        found = found.where(~F.col("file").contains(x))
    found = found.join(found.groupBy("target").agg(F.count("*").alias("total")), "target")
    if limit is not None:
        order = Window.partitionBy("target").orderBy("file", "name", "source", "kind", "confidence")
        found = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= limit).drop("r")
    return found.select("target", "source", "name", "file", "kind", "confidence", "total")


def file_matches(file, query: str, strict: bool = False):
    """Equal, a tail either way, a part (unless strict), or the same base name (strict, or query without a slash); \\ counts as /."""
    file, query = F.replace(file, F.lit("\\"), F.lit("/")), query.replace("\\", "/")
    out = (file == query) | file.endswith(query) | F.lit(query).endswith(file)
    if strict:
        return out | (basename(file) == query.rpartition("/")[2])
    out = out | file.contains(query)
    return out if "/" in query else out | (basename(file) == query)


def file_symbols(graph: CodeGraph, files: list[str]) -> DataFrame:
    """(query, id, name, kind, start_line, file): symbols of each file asked for, once each; a file without any gives one row of nulls."""
    out, n = None, graph.nodes.where(~F.col("kind").isin(S.STRUCTURAL))
    for q in dict.fromkeys(files):
        part = n.where(file_matches(F.col("file"), q)).select(F.lit(q).alias("query"), "id", "name", "kind", "start_line", "file")
        asked = graph.nodes.sparkSession.createDataFrame([(q,)], "query string")
        part = asked.join(part, "query", "left")
        out = part if out is None else out.unionByName(part)
    return out


def file_map(graph: CodeGraph, module: str | None = None) -> DataFrame:
    """(module, directory, file_count, symbol_count)."""
    n = graph.nodes.select(F.coalesce("module", F.lit("(unknown)")).alias("module"), dirname(F.col("file")).alias("directory"), "file")
    if module is not None:
        n = n.where(F.lower("module") == module.lower())
    return n.groupBy("module", "directory").agg(F.countDistinct("file").alias("file_count"), F.count("*").alias("symbol_count"))


# Kinds of a dependency in the order that a report lists them.
DEPENDENCY_KINDS = ["normal", "dev", "build", "workspace"]


def dependencies(graph: CodeGraph, name: str | None = None) -> DataFrame:
    """(package, manifest, name, package_name, version_req, source, source_detail, kind, inherited_workspace, package_id, dependency_id, repo, place).

    Manifest dependencies between package and dependency nodes; name takes those so called, or whose package is. place
    numbers the report's rows: by repo, manifest, kind, name.
    """
    got = lambda side, k: F.try_element_at(f"{side}_meta", F.lit(f"cargo.{k}"))
    side = lambda df, s, c: df.select(F.col("id").alias(c), *[F.col(x).alias(f"{s}_{x}") for x in ("name", "file", "repo")], F.col("metadata").alias(f"{s}_meta"))
    role = lambda r: F.try_element_at("metadata", F.lit("cargo.node")) == r
    e = graph.edges.where("kind = 'depends_on'").select("source", "target")
    e = e.join(side(graph.nodes.where(role("package")), "p", "source"), "source").join(side(graph.nodes.where(role("dependency")), "d", "target"), "target")
    tail = F.try_element_at(F.split("target", "::cargo_dependency::"), F.lit(2))
    kind = F.coalesce(got("d", "dependency.kind"), F.substring_index(tail, "::", 1), F.lit("normal"))
    out = e.select(
        F.coalesce(got("d", "package.name"), got("p", "package.name"), "p_name").alias("package"),
        F.coalesce(got("d", "manifest_path"), F.replace("d_file", F.lit("\\"), F.lit("/"))).alias("manifest"),
        F.coalesce(got("d", "dependency.name"), "d_name").alias("name"), got("d", "dependency.package").alias("package_name"),
        got("d", "dependency.version_req").alias("version_req"), F.coalesce(got("d", "dependency.source"), F.lit("registry")).alias("source"),
        got("d", "dependency.source_detail").alias("source_detail"), kind.alias("kind"),
        F.coalesce(got("d", "dependency.inherited_workspace") == "true", F.lit(False)).alias("inherited_workspace"),
        F.col("source").alias("package_id"), F.col("target").alias("dependency_id"), F.coalesce("d_repo", "p_repo").alias("repo"),
    )
    if name is not None:
        out = out.where((F.col("name") == name) | F.coalesce(F.col("package_name") == name, F.lit(False)))
    rank = F.array_position(F.array(*map(F.lit, DEPENDENCY_KINDS)), F.col("kind"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.coalesce("repo", F.lit("")), "manifest", F.when(rank > 0, rank).otherwise(5), "name", "package_id", "dependency_id")  # a report of manifests
    return out.withColumn("place", F.row_number().over(order))


def module_of_files(files: DataFrame, modules: DataFrame) -> DataFrame:
    """(file, module): files (file) by the longest directory of modules (module, dir) that holds them; else their first path component."""
    # each directory prefix of a file is a row, so the join is by equality
    parts = F.split("file", "/")
    prefixes = files.select("file", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("dir"))
    best = prefixes.join(modules.select("module", F.rtrim("dir", F.lit("/")).alias("dir")), "dir").groupBy("file").agg(F.max(F.struct(F.length("dir"), "module")).alias("b"))
    return files.join(best, "file", "left").select("file", F.coalesce("b.module", F.split("file", "/")[0]).alias("module"))
