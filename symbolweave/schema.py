"""Schemas and closed domains of the code graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERSION = "0.1.0"
# The domains of the data model.
NODE_KINDS = [
    "file", "function", "method", "class", "struct", "enum", "enum_member", "trait", "impl", "module", "namespace", "field", "variant", "property", "variable",
    "constant", "type_alias", "parameter", "import", "export", "package", "route", "component", "protocol", "extension", "view", "branch",
]
EDGE_KINDS = [
    "calls", "uses", "imports", "exports", "implements", "contains", "type_ref", "references", "type_of", "returns", "inherits", "extends",
    "instantiates", "overrides", "decorates", "reads", "writes", "publishes", "subscribes", "depends_on",
]
VISIBILITIES = ["public", "crate", "private"]
TERMINAL_KINDS = ["network", "persistence", "cache", "event", "keychain", "search"]
DIRECTIONS = ["read", "write", "read_write", "pure"]

# Classes of kinds that operators ask for.
DATAFLOW = ["calls", "reads", "writes", "publishes", "subscribes"]
IMPACT = ["calls", "reads", "implements", "type_ref", "inherits"]
USAGE = ["calls", "reads", "writes", "uses", "type_ref", "references", "implements", "instantiates", "returns", "type_of"]
ARCH = ["calls", "uses", "type_ref", "implements", "inherits"]
SEEDED = ["struct", "class", "enum", "protocol", "trait"]
API = ["function", "method", "property", "field", "constant", "type_alias", "struct", "class", "enum", "protocol", "trait"]
STRUCTURAL = ["view", "branch"]

NODES = """id string, kind string, name string, file string, start_line int, start_col int, end_line int, end_col int, visibility string,
metadata map<string,string>, role_type string, terminal_kind string, signature string, doc_comment string, module string, snippet string, repo string"""
EDGES = """source string, target string, kind string, confidence double, direction string, operation string, condition string,
async_boundary boolean, provenance array<struct<file:string,start_line:int,start_col:int,end_line:int,end_col:int,symbol_id:string>>, repo string"""
KEY = ["source", "target", "kind", "direction", "operation", "condition", "async_boundary", "repo"]


def edge_text() -> Column:
    """What the key of an edge is the hash of: confidence and provenance have no part, and null equals the empty string."""
    return F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in KEY])


def edge_id() -> Column:
    """The key of an edge."""
    return F.sha2(edge_text(), 256)


def invalid_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(table, key, column, value) of what lies outside its domain."""
    checks = [(nodes, "nodes", "id", "kind", NODE_KINDS), (nodes, "nodes", "id", "visibility", VISIBILITIES), (nodes, "nodes", "id", "terminal_kind", TERMINAL_KINDS),
              (edges, "edges", "source", "kind", EDGE_KINDS), (edges, "edges", "source", "direction", DIRECTIONS)]
    out = None
    for df, table, key, column, domain in checks:
        bad = df.where(~F.col(column).isin(domain)).select(F.lit(table).alias("table"), F.col(key).alias("key"), F.lit(column).alias("column"), F.col(column).alias("value"))
        out = bad if out is None else out.unionByName(bad)
    return out
