"""The code graph: two DataFrames, and the operators that give a graph again."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symbolweave import schema as S
from symbolweave.runtime import cut, drop_shuffles, shared_dir

# Other names that a kind filter takes; a package can't be asked for.
KIND_ALIASES = {"fn": "function", "variant_member": "enum_member", "mod": "module", "var": "variable", "const": "constant", "typealias": "type_alias", "param": "parameter", "ext": "extension"}
NODE_FIELDS = ["id", "kind", "name", "file", "module", "visibility", "role_type", "terminal_kind", "signature", "doc_comment", "snippet", "repo", "start_line", "end_line"]
#: Rows of both versions beyond which a delta is made by parts, changed nodes up to which their ids are broadcast, and buckets of a kind.
DELTA_ROWS, DELTA_IDS, DELTA_BUCKETS = 10_000_000, 500_000, 64


@dataclass(frozen=True)
class CodeGraph:
    """nodes and edges with the schemas of symbolweave.schema. Every method is lazy and gives a DataFrame or a graph."""

    nodes: DataFrame
    edges: DataFrame
    version: str = S.VERSION

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> CodeGraph:
        return cls(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"))

    def write(self, path: str, edges: Sequence[DataFrame] = ()) -> None:
        """Parquet by kind, so that a filter on kinds prunes partitions. edges: all edges in parts, written one after another, so that one part's shuffle is on disk at a time."""
        for name, parts in (("nodes", [self.nodes]), ("edges", edges or [self.edges])):
            for n, part in enumerate(parts):
                part.write.mode("append" if n else "overwrite").option("compression", "zstd").partitionBy("kind").parquet(f"{path}/{name}")
                drop_shuffles(part.sparkSession)

    def written(self, path: str | None = None, edges: Sequence[DataFrame] = ()) -> CodeGraph:
        """The same graph read from where it was just written: operators that use it many times plan and compute it once."""
        spark = self.nodes.sparkSession
        path = path or f"{shared_dir(spark)}/graph-{uuid.uuid4().hex}"
        self.write(path, edges)
        read = {n: spark.read.schema(df.schema).parquet(f"{path}/{n}").select(df.columns) for n, df in (("nodes", self.nodes), ("edges", self.edges))}
        return CodeGraph(**read, version=self.version)

    def transform(self, step) -> CodeGraph:
        """step: CodeGraph -> CodeGraph, a pass."""
        return step(self)

    # -- selection
    def filter_kinds(self, kinds: Sequence[str] | str) -> CodeGraph:
        """Nodes of the kinds, and edges with both ends among them."""
        names = kinds.split(",") if isinstance(kinds, str) else kinds
        names = [KIND_ALIASES.get(k.strip(), k.strip()) for k in names]
        unknown = sorted(set(names) - set(S.NODE_KINDS) | set(names) & {"package"})
        if unknown:
            raise ValueError(f"unknown kinds: {unknown}")
        return self._induced(self.nodes.where(F.col("kind").isin(names)))

    def _induced(self, nodes: DataFrame) -> CodeGraph:
        ids = nodes.select("id")
        edges = self.edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
        return CodeGraph(nodes, edges.select(self.edges.columns), self.version)

    def prune(self, keep_variants: bool = False) -> CodeGraph:
        """Without non-public fields and variants, uses edges to nowhere, and other edges that miss an end."""
        gone = F.col("kind").isin("field", "variant") & (F.col("visibility") != "public")
        return self._induced(self.nodes if keep_variants else self.nodes.where(~gone))

    def select_nodes(self, id=None, name=None, kind=None, module=None, file_suffix=None, role=None, metadata_key=None) -> DataFrame:
        """Nodes that fit every selector given."""
        tests = [F.col(c) == v for c, v in (("id", id), ("name", name), ("kind", kind), ("module", module), ("role_type", role)) if v is not None]
        if file_suffix is not None:
            tests.append(F.col("file").endswith(file_suffix))
        if metadata_key is not None:
            tests.append(F.map_contains_key("metadata", metadata_key))
        return self.nodes.where(reduce(and_, tests)) if tests else self.nodes

    def select_edges(self, source=None, kind=None, target=None, external_only=False, terminal_kind=None) -> DataFrame:
        """Edges that fit every selector given; external_only: the target is no node."""
        tests = [F.col(c) == v for c, v in (("source", source), ("kind", kind), ("target", target)) if v is not None]
        out = self.edges.where(reduce(and_, tests)) if tests else self.edges
        if external_only:
            out = out.join(self.nodes.select(F.col("id").alias("target")), "target", "left_anti")
        if terminal_kind is not None:
            ends = self.nodes.where(F.col("terminal_kind") == terminal_kind).select(F.col("id").alias("target"))
            out = out.join(ends, "target", "left_semi")
        return out.select(self.edges.columns)

    def select_artifacts(self, prefix: str) -> DataFrame:
        """(id, key, value) of metadata whose key starts with prefix: l10n. or asset. references."""
        return self.nodes.select("id", F.explode("metadata").alias("key", "value")).where(F.col("key").startswith(prefix))

    def lookup(self, ids: Sequence[str]) -> DataFrame:
        """The nodes of ids in the order asked for, unknown ones left out."""
        asked = self.nodes.sparkSession.createDataFrame(list(enumerate(ids)), "pos int, id string")
        return self.nodes.join(F.broadcast(asked), "id").orderBy("pos")

    def union(self, other: CodeGraph, repo: str | None = None) -> CodeGraph:
        """Both graphs' rows; repo: the other's ids are put into that repository's name space."""
        nodes, edges = other.nodes, other.edges
        if repo is not None:
            named = lambda c: F.concat(F.lit(f"{repo}::"), F.col(c))
            nodes = nodes.withColumns({"id": named("id"), "repo": F.lit(repo)})
            edges = edges.withColumns({"source": named("source"), "target": named("target"), "repo": F.lit(repo)})
        return CodeGraph(self.nodes.unionByName(nodes), self.edges.unionByName(edges), self.version)

    # -- normal form
    def normalise(self) -> CodeGraph:
        """One row for each node id and each edge key.

        Nodes: struct is raised to class, visibility to the widest, optional fields take the first value by rank
        (file, line), metadata the first value of each key; the snippet is that of the first row. Edges: the largest
        confidence and all distinct provenance.
        """
        rank = F.create_map(*[F.lit(x) for p in (("public", 0), ("crate", 1), ("private", 2)) for x in p])
        # one order for all; what comes after the position only settles ties
        at = F.struct("file", "start_line", "start_col", "name", "kind", "end_line", "end_col", "visibility", "module", "signature", "doc_comment", "snippet", F.array_sort(F.map_entries("metadata")).alias("m"))
        present = lambda c: F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col("at")))
        whole = ["name", "file", "start_line", "start_col", "end_line", "end_col", "snippet"]
        first = F.min_by(F.struct("kind", *whole), "at")
        entries = F.array_sort(F.collect_list(F.when(F.size("metadata") > 0, F.struct("at", F.map_entries("metadata").alias("entries")))))
        merged = F.aggregate(F.flatten(F.transform(entries, lambda x: x["entries"])), F.create_map().cast("map<string,string>"),
                             lambda m, e: F.when(F.map_contains_key(m, e["key"]), m).otherwise(F.map_concat(m, F.create_map(e["key"], e["value"]))))
        nodes = self.nodes.withColumn("at", at).groupBy("id").agg(
            first.alias("first"), F.max((F.col("kind") == "class").cast("int")).alias("is_class"), F.min_by("visibility", F.struct(F.coalesce(F.try_element_at(rank, F.col("visibility")), F.lit(3)), "visibility")).alias("visibility"),
            merged.alias("metadata"), *[present(c).alias(c) for c in ("role_type", "terminal_kind", "signature", "doc_comment", "module", "repo")],
        )
        kind = F.when((F.col("is_class") == 1) & F.col("first.kind").isin("struct", "class"), "class").otherwise(F.col("first.kind"))
        nodes = nodes.withColumns({"kind": kind} | {c: F.col("first")[c] for c in whole}).select(self.nodes.columns)
        keyed = self.edges.withColumn("edge_id", S.edge_id())
        rest = [F.first(c).alias(c) for c in S.KEY]
        edges = keyed.groupBy("edge_id").agg(*rest, F.max("confidence").alias("confidence"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("provenance")))).alias("provenance"))
        return CodeGraph(nodes, edges.select(self.edges.columns), self.version)

    def delta(self, new: CodeGraph, rows: int = DELTA_ROWS) -> DataFrame:
        """(item, key, change_type) from this version to new, both in normal form; edges go by key, so only other confidence or provenance is an update.

        Edges are compared by key in one grouping of both versions' rows; nodes are normalised only where the rows of an
        id differ. Beyond so many rows, each kind's rows are dealt into buckets by key, and only buckets whose rows differ
        between the versions are compared, in parts of an eighth of the rows or one bucket, one after another, each written
        before the next, so that one part's shuffle is on disk at a time.
        """
        spark = self.nodes.sparkSession
        total = reduce(DataFrame.unionAll, [df.select("kind") for g in (self, new) for df in (g.nodes, g.edges)]).count()
        if total <= rows:
            return self._node_changes(new, _other_nodes(self.nodes, new.nodes)).unionByName(_edge_changes(self.edges, new.edges))

        def done(part: DataFrame, tag: str) -> DataFrame:
            out = cut(part, tag)
            drop_shuffles(spark)
            return out

        ids = [done(_other_nodes(self.nodes.where(of), new.nodes.where(of)), "delta-ids") for of in _parts(self.nodes, new.nodes, F.col("id"), _row_text(self.nodes), total // 8)]
        ids = reduce(DataFrame.unionAll, ids).distinct()
        parts = [done(self._node_changes(new, F.broadcast(ids) if ids.count() <= DELTA_IDS else ids), "delta-nodes")]
        # what an edge has besides its key; an empty provenance equals none
        rest = F.to_json(F.struct("confidence", F.when(F.size("provenance") > 0, F.col("provenance")).alias("provenance")))
        for of in _parts(self.edges, new.edges, S.edge_text(), rest, total // 8):
            parts.append(done(_edge_changes(self.edges.where(of), new.edges.where(of)), "delta-edges"))
        return reduce(DataFrame.unionByName, parts)

    def _node_changes(self, new: CodeGraph, ids: DataFrame) -> DataFrame:
        """The node half of the delta, for the nodes of ids (other)."""
        def side(graph, name):
            nodes = graph.nodes.join(ids, F.col("id").eqNullSafe(F.col("other")), "left_semi")
            nodes = CodeGraph(nodes, graph.edges).normalise().nodes
            return nodes.select(F.col("id").alias(f"{name}_id"), F.sha2(_row_text(nodes, "id"), 256).alias(name))

        both = side(self, "was").join(side(new, "now"), F.col("was_id").eqNullSafe(F.col("now_id")), "full_outer")
        change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted").when(F.col("was") != F.col("now"), "updated")
        return both.select(F.lit("node").alias("item"), F.coalesce("was_id", "now_id").alias("key"), change.alias("change_type")).where("change_type IS NOT NULL")

    def compact(self) -> DataFrame:
        """(file, symbol, relation, names): each symbol's members, calls, supertypes, reads and writes by name, one row a relation."""
        targets = self.nodes.select(F.col("id").alias("target"), F.col("name").alias("target_name"))
        own = self.nodes.select(F.col("id").alias("source"), "file", F.col("name").alias("symbol"))
        relation = F.when(F.col("kind") == "contains", "members").when(F.col("kind").isin("publishes", "subscribes"), "writes").otherwise(F.col("kind"))
        prefix = F.when(F.col("kind") == "publishes", "publish:").when(F.col("kind") == "subscribes", "subscribe:").otherwise("")
        known = self.edges.where(F.col("kind").isin("contains", "calls", "implements", "inherits", "type_ref", "reads", "writes", "publishes", "subscribes"))
        name = F.coalesce("target_name", F.element_at(F.split("target", "::"), -1))
        rows = known.join(targets, "target", "left").select("source", relation.alias("relation"), F.concat(prefix, name).alias("n"))
        return rows.groupBy("source", "relation").agg(F.array_sort(F.collect_list("n")).alias("names")).join(own, "source").select(F.col("source").alias("id"), "file", "symbol", "relation", "names")

    def project(self, fields: str | Sequence[str] = "file") -> DataFrame:
        """id, name, kind and the fields asked for: a list, or all, full or none; unknown names count for nothing."""
        asked = fields if not isinstance(fields, str) else {"all": NODE_FIELDS, "full": NODE_FIELDS, "none": []}.get(fields, fields.split(","))
        return self.nodes.select("id", "name", "kind", *[f for f in NODE_FIELDS if f in {x.strip() for x in asked} - {"id", "name", "kind"}])


def _row_text(df: DataFrame, *but: str):
    """A row as text, maps as their sorted entries."""
    columns = [F.array_sort(F.map_entries(c)).alias(c) if t.startswith("map") else F.col(c) for c, t in sorted(df.dtypes) if c not in but]
    return F.to_json(F.struct(*columns))


def _parts(old: DataFrame, new: DataFrame, key: Column, rest: Column, most: int) -> list[Column]:
    """Filters on both versions, of about so many rows each or one bucket, that together keep every row of a bucket that differs.

    A bucket: rows of one kind by a hash of key. Rows are hashed to 128 bits (key and rest), and the halves of those hashes
    summed, so a bucket differs where its rows, as a bag, do.
    """
    kind, bucket = F.coalesce("kind", F.lit("")), F.pmod(F.xxhash64(key), F.lit(DELTA_BUCKETS))
    hashes = [F.xxhash64(F.lit(seed), "key", "rest") for seed in (0, 1)]
    side = lambda df, n: df.select(kind.alias("kind"), bucket.alias("bucket"), key.alias("key"), rest.alias("rest"), F.lit(n).alias("n")).select("kind", "bucket", "n", *[h.alias(f"h{i}") for i, h in enumerate(hashes)])
    halves = [h for i in range(2) for h in (F.col(f"h{i}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"h{i}", 32))]
    # a sum that overflows is null: such a bucket is compared
    sums = [F.coalesce(F.try_sum(F.col("n") * h), F.lit(1)) != 0 for h in halves]
    cells = side(old, -1).unionAll(side(new, 1)).groupBy("kind", "bucket").agg(F.count("*").alias("rows"), reduce(or_, sums, F.sum("n") != 0).alias("differs")).where("differs").orderBy("kind", "bucket").collect()
    # parts of even size
    each = (total := sum(c["rows"] for c in cells)) / max(1, -(-total // max(1, most)))
    parts, before = {}, 0
    for c in cells:
        parts.setdefault(int(before // each), {}).setdefault(c["kind"], []).append(c["bucket"])
        before += c["rows"]
    among = lambda k, buckets: (kind == k) & bucket.isin(buckets) if len(buckets) < DELTA_BUCKETS else kind == k
    return [reduce(or_, [among(*x) for x in part.items()]) for part in parts.values()] or [F.lit(False)]


def _other_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(other): ids whose rows, as a bag, differ by hashes of 128 bits."""
    side = lambda df, n: df.select(F.col("id").alias("other"), _row_text(df, "id").alias("t"), F.lit(n).alias("n")).select("other", F.xxhash64("t").alias("h"), F.xxhash64(F.lit(1), "t").alias("h2"), "n")
    return side(old, -1).unionByName(side(new, 1)).groupBy("other", "h", "h2").agg(F.sum("n").alias("n")).where("n <> 0").select("other").distinct()


def _edge_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """The edge half of the delta: of a key the largest confidence and the distinct provenance of either version are compared."""
    # a struct around each spot tells one that is null from none
    spots = F.explode_outer(F.transform("provenance", lambda p: F.struct(p.alias("p"))))
    side = lambda df, n: df.select(S.edge_text().alias("text"), "confidence", spots.alias("spot"), F.lit(n).alias("n"))
    rows = side(old, 0).unionByName(side(new, 1)).repartition("text")
    of = lambda n, c: F.max(F.when(F.col("n") == n, c))
    at = rows.groupBy("text", "spot").agg(*[of(n, v).alias(f"{name}{c}") for n, name in enumerate(("was", "now")) for c, v in (("", F.lit(True)), ("_c", F.col("confidence")))])
    moved = F.max(F.col("spot").isNotNull() & (F.col("was").isNull() | F.col("now").isNull()))
    keys = at.groupBy("text").agg(*[F.max(c).alias(c) for c in ("was", "now", "was_c", "now_c")], moved.alias("moved"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted").when(~F.col("was_c").eqNullSafe(F.col("now_c")) | F.col("moved"), "updated")
    return keys.withColumn("change_type", change).where("change_type IS NOT NULL").select(F.lit("edge").alias("item"), F.sha2("text", 256).alias("key"), "change_type")
