"""Index status, work plans, freshness, session recall, snippets and strings shown by a subtree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symbolweave.functions.text import basename
from symbolweave.graph import CodeGraph
from symbolweave.operators.localization import resolve_usages
from symbolweave.operators.structure import resolve
from symbolweave.operators.traverse import reach
from symbolweave.runtime import cut

#: Bytes that a compact snippet keeps.
COMPACT_BYTES = 600
#: Unicode white space.
SPACE = r"[\p{Z}\s\x0B\x{85}]"
# What inputs of each kind end in, and manifests.
GRAPH_ENDS, STRING_ENDS = (".swift", ".rs"), (".xcstrings", ".strings")
MANIFESTS = ["Package.swift", "Cargo.toml"]


def input_kind(path: Column, graph_config: str = "project.toml", strings_config: str = "strings.toml") -> Column:
    """graph, localization or assets: what a changed file makes stale; null: nothing. The names of config files are parameters."""
    name = basename(path)
    ends = lambda xs: path.rlike("(" + "|".join(x.replace(".", r"\.") for x in xs) + r")\z")
    return (F.when(name.isin(graph_config, *MANIFESTS), "graph").when(name == strings_config, "localization").when(path.rlike(r"\.(xcodeproj|xcworkspace)(/|\z)"), "graph")
            .when(path.rlike(r"\.xcassets(/|\z)"), "assets").when(ends(GRAPH_ENDS), "graph").when(ends(STRING_ENDS), "localization"))


def changed_files(indexed: DataFrame, current: DataFrame, between_heads: DataFrame | None = None) -> DataFrame:
    """(path, kind): files whose stamps (path, stamp) differ or that only one side has, and those changed between both heads (path)."""
    both = indexed.select("path", F.col("stamp").alias("was")).join(current.select("path", F.col("stamp").alias("now")), "path", "full")
    out = both.where(~F.col("was").eqNullSafe(F.col("now"))).select("path")
    out = out if between_heads is None else out.union(between_heads.select("path"))
    return out.distinct().withColumn("kind", input_kind(F.col("path")))


def index_status(changed: DataFrame, borrowed: bool = False, tracked: bool = True) -> DataFrame:
    """One row: changed_files, changed_inputs, temporary, may_be_stale (a borrowed index, or any input changed), tracked."""
    inputs = F.count("kind")
    return changed.agg(F.count("*").alias("changed_files"), inputs.alias("changed_inputs"), F.lit(borrowed).alias("temporary"),
                       (F.lit(borrowed) | (F.lit(tracked) & (inputs > 0))).alias("may_be_stale"), F.lit(tracked).alias("tracked"))


def work_plan(changed: DataFrame) -> DataFrame:
    """One row: which of the graph, the localization and the assets are to be rebuilt."""
    hit = lambda kind: F.coalesce(F.bool_or(F.col("kind") == kind), F.lit(False))
    return changed.agg(hit("graph").alias("graph"), hit("localization").alias("localization"), hit("assets").alias("assets"))


def freshness(status: DataFrame, matches: bool = True) -> DataFrame:
    """One row for answers to carry: stale, current or untracked; unknown if the status is not of the graph at hand."""
    state = F.when(~F.lit(matches), "unknown").when(F.col("may_be_stale"), "stale").when(F.col("tracked"), "current").otherwise("untracked")
    return status.select(F.lit("resolved_index_matches").alias("result_scope"), state.alias("freshness"), "changed_inputs")


class Recall:
    """A session's last resolutions by base name: an ambiguous query takes the remembered id if it is among its candidates."""

    def __init__(self):
        self.ids: dict[str, str] = {}

    @staticmethod
    def key(query: str) -> str:
        return query.rpartition("::")[2].split("(")[0].removeprefix("getter:").removeprefix("setter:").lower()

    def resolve(self, graph: CodeGraph, query: str) -> DataFrame:
        """The rows of resolve(); one, if it is a hit or was one before."""
        found = resolve(graph, query)
        some = found.select("id").limit(2).collect()
        if len(some) == 1:
            self.ids[self.key(query)] = some[0]["id"]
        elif some and (known := self.ids.get(self.key(query))):
            mine = found.where(F.col("id") == known)
            return mine if mine.limit(1).count() else found
        return found

    def prune(self, nodes: DataFrame) -> None:
        """Forgets ids that are no nodes any more."""
        left = {r["id"] for r in nodes.where(F.col("id").isin(list(self.ids.values()))).select("id").collect()}
        self.ids = {k: v for k, v in self.ids.items() if v in left}


def _trim_end(x: Column) -> Column:
    return F.regexp_replace(x, SPACE + r"+\z", "")


def full_lines(text: Column, start: Column, end: Column) -> Column:
    """Lines start to end of text, both counted from 0 and included; null past its end."""
    lines = F.split(text, "\n", -1)
    return F.when(start < F.size(lines), F.regexp_replace(F.array_join(F.slice(lines, start + 1, F.greatest(end - start + 1, F.lit(0))), "\n"), r"[\r\n]+\z", ""))


def deindent(snippet: Column) -> Column:
    """Without the white space that all lines with text begin with, and without any at line ends and empty lines around."""
    lines = F.transform(F.split(snippet, "\n", -1), _trim_end)
    indent = F.array_min(F.transform(F.filter(lines, lambda x: x != ""), lambda x: F.length(x) - F.length(F.regexp_replace(x, "^" + SPACE + "+", ""))))
    cut = F.transform(lines, lambda x: F.substring(x, F.coalesce(indent, F.lit(0)) + 1, F.length(x)))
    return F.regexp_replace(F.array_join(cut, "\n"), r"^\n+|\n+\z", "")


def compact(snippet: Column) -> Column:
    """One line: trimmed lines that are not empty, joined by a space; over COMPACT_BYTES of UTF-8 cut at a character, then ' ...'."""
    lines = F.transform(F.split(snippet, "\n", -1), lambda x: F.regexp_replace(_trim_end(x), "^" + SPACE + "+", ""))
    line = F.array_join(F.filter(lines, lambda x: x != ""), " ")
    raw = line.cast("binary")
    size = F.when(F.hex(F.substring(raw, COMPACT_BYTES + 1, 1)).between("80", "BF"), _boundary(raw)).otherwise(F.lit(COMPACT_BYTES))
    # a byte 80 to BF continues a character, which has at most four bytes
    return F.when(F.octet_length(line) <= COMPACT_BYTES, line).otherwise(F.concat(_trim_end(F.substring(raw, F.lit(1), size).cast("string")), F.lit(" ...")))


def _boundary(raw: Column) -> Column:
    """The last of the places COMPACT_BYTES - 3 to COMPACT_BYTES - 1 at which a character of raw ends."""
    out = F.lit(COMPACT_BYTES - 3)
    for back in (2, 1):
        out = F.when(F.hex(F.substring(raw, COMPACT_BYTES - back + 1, 1)).between("80", "BF"), out).otherwise(F.lit(COMPACT_BYTES - back))
    return out


def localize(graph: CodeGraph, symbol: str, usages: DataFrame, catalog: DataFrame, wrappers: DataFrame) -> DataFrame:
    """(id, name, depth, table, key, catalog_file, match_kind): uses of strings (as of resolve_usages) in what symbol contains, itself included."""
    holds = graph.edges.where("kind = 'contains'").select(F.col("source").alias("src"), F.col("target").alias("dst"))
    seeds = graph.nodes.where(F.col("id") == symbol).select(F.col("id").alias("root"), "id")
    tree = cut(reach(holds, seeds).select("id", "depth").join(graph.nodes.select("id", "name"), "id"), "localize-tree")
    mine = usages.join(tree.select("id"), "id", "left_semi")
    refs = graph.edges.where("kind = 'type_ref'").select(F.col("source").alias("id"), F.col("target").alias("wrapper_id")).join(wrappers.select("wrapper_id"), "wrapper_id", "left_semi")
    return tree.join(resolve_usages(mine, catalog, wrappers, refs), "id").select("id", "name", "depth", "table", "key", "catalog_file", "match_kind")
