"""Status, recall, snippets and localization on small cases with known answers."""

from pyspark.sql import functions as F

from symbolweave.operators import upkeep
from tests.test_graph import got, graph


def test_status_and_plan(spark):
    old = spark.createDataFrame([("a.rs", 1), ("b.md", 1), ("gone.strings", 1), ("same.rs", None)], "path string, stamp long")
    new = spark.createDataFrame([("a.rs", 1), ("b.md", 2), ("x.xcassets/s.json", 1), ("same.rs", None)], "path string, stamp long")
    changed = upkeep.changed_files(old, new)
    assert sorted(map(tuple, changed.collect())) == [("b.md", None), ("gone.strings", "localization"), ("x.xcassets/s.json", "assets")]
    status = upkeep.index_status(changed)
    assert tuple(status.first()) == (3, 2, False, True, True)
    assert tuple(upkeep.work_plan(changed).first()) == (False, True, True)
    assert upkeep.freshness(status).first()["freshness"] == "stale"
    assert upkeep.freshness(status, matches=False).first()["freshness"] == "unknown"
    none = upkeep.changed_files(old, old, spark.createDataFrame([("m.md",)], "path string"))
    assert upkeep.freshness(upkeep.index_status(none)).first()["freshness"] == "current"
    assert upkeep.freshness(upkeep.index_status(none, tracked=False)).first()["freshness"] == "untracked"
    assert upkeep.index_status(none, borrowed=True).first()["may_be_stale"] is True


def test_recall(spark):
    g = graph(spark, [("a::run", "function", {"name": "run"}), ("b::run", "function", {"name": "run"}), ("only", "function")], [])
    session = upkeep.Recall()
    assert session.resolve(g, "run").count() == 2
    assert got(session.resolve(g, "a::run"), "id") == [("a::run",)]
    assert got(session.resolve(g, "run"), "id") == [("a::run",)]
    session.prune(g.nodes.where("id <> 'a::run'"))
    assert session.ids == {} and session.resolve(g, "run").count() == 2
    assert session.resolve(g, "nowhere").count() == 0


def test_snippets(spark):
    texts = ["", None, "  a\n\n    b  \n", "x" * 601, "é" * 301, "x" * 599 + "é", "x" * 598 + " é", "x" * 597 + "\U0001f600y", "x" * 599 + "\U0001f600"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = {r["i"]: r["s"] for r in rows.select("i", upkeep.compact(F.col("t")).alias("s")).collect()}
    assert found == {0: "", 1: None, 2: "a b", 3: "x" * 600 + " ...", 4: "é" * 300 + " ...", 5: "x" * 599 + " ...", 6: "x" * 598 + " ...", 7: "x" * 597 + " ...", 8: "x" * 599 + " ..."}
    lines = rows.where("i = 2").select(upkeep.deindent(F.col("t")), upkeep.full_lines(F.col("t"), F.lit(2), F.lit(9)), upkeep.full_lines(F.col("t"), F.lit(4), F.lit(9))).first()
    assert tuple(lines) == ("a\n\n  b", "    b  ", None)


def test_localize(spark):
    g = graph(spark, [(x, "view") for x in ("top", "mid", "leaf", "other")], [("top", "contains", "mid"), ("mid", "contains", "leaf")])
    usages = spark.createDataFrame([("leaf", "a.rs", "L", "hello", None, None), ("mid", "a.rs", "L", "none", "hello", None), ("other", "a.rs", "L", "hello", None, None)], "id string, file string, table string, key string, literal string, wrapper_name string")
    catalog = spark.createDataFrame([("L", "hello", "Hello", "L.strings", "")], "table string, key string, value string, catalog_file string, catalog_dir string")
    wrappers = spark.createDataFrame([], "wrapper_id string, wrapper_name string, table string, key string")
    assert got(upkeep.localize(g, "top", usages, catalog, wrappers), "id", "depth", "key", "match_kind") == [("leaf", 2, "hello", "direct_metadata"), ("mid", 1, "hello", "literal_key")]
