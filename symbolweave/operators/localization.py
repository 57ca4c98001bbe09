"""Localization: which catalog record a use of a string means, and where a string is used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symbolweave.functions.text import directory_distance, dirname, key_from_wrapper, phrase
from symbolweave.runtime import cut

RECORD = ["table", "key", "value", "catalog_file", "catalog_dir"]
MATCH = ["id", "file", "catalog_file", "table", "key", "wrapper_id", "match_kind"]
#: Letters that names must share at their start to be taken for one another.
PREFIX = 4


def _nearest(found: DataFrame) -> DataFrame:
    """Of the records that each use (by id, file, wrapper_id and what was asked for) found, those in the nearest directories."""
    far = found.withColumn("far", directory_distance(dirname(F.col("file")), F.col("catalog_dir")))
    return far.withColumn("r", F.rank().over(Window.partitionBy("id", "wrapper_id", "asked").orderBy("far"))).where("r = 1").drop("r", "far").dropDuplicates(["id", "wrapper_id", "catalog_file", "table", "key"])


def _open(usages: DataFrame, *matched: DataFrame) -> DataFrame:
    """Uses without a match so far."""
    for m in matched:
        usages = usages.join(m.select("id").distinct(), "id", "left_anti")
    return usages


def common_prefix(a: Column, b: Column) -> Column:
    x, y = F.split(a, ""), F.split(b, "")
    differ = F.zip_with(x, y, lambda p, q: ~F.coalesce(p == q, F.lit(False)))
    at = F.array_position(differ, True)
    return F.when(at > 0, at - 1).otherwise(F.least(F.length(a), F.length(b)))


def wrappers_by_name(usages: DataFrame, wrappers: DataFrame) -> DataFrame:
    """(id, wrapper_id, how): wrappers whose name is that of the use: exactly, else word for word, else the one name most alike.

    Alike: two words or more in common, PREFIX letters at the start, at most half of the longer name in edits; by words
    in common, letters at the start and edits there must be one best.
    """
    u = usages.where("wrapper_name IS NOT NULL").select("id", F.col("wrapper_name").alias("asked_name")).withColumn("asked_words", phrase(F.col("asked_name")))
    w = wrappers.select("wrapper_id", F.col("wrapper_name").alias("name")).withColumn("words", phrase(F.col("name")))
    exact = u.join(w, F.col("asked_name") == F.col("name")).select("id", "wrapper_id", F.lit("wrapper_name_exact").alias("how"))
    rest = _open(u, exact)
    tokens = rest.join(w, F.col("asked_words") == F.col("words")).select("id", "wrapper_id", F.lit("wrapper_name_tokens").alias("how"))
    rest = _open(rest, tokens)
    low = lambda c: F.lower(c)
    pairs = rest.withColumn("start", F.substring(low("asked_name"), 1, PREFIX)).join(w.withColumn("start", F.substring(low("name"), 1, PREFIX)), "start").where(F.length("start") == PREFIX)
    shared = F.size(F.filter(F.split("words", " "), lambda t: F.array_contains(F.split("asked_words", " "), t)))
    pairs = pairs.select("id", "wrapper_id", shared.alias("shared"), common_prefix(low("name"), low("asked_name")).alias("start"), F.levenshtein(low("name"), low("asked_name")).alias("edits"), F.greatest(F.length("name"), F.length("asked_name")).alias("longest"))
    good = pairs.where("shared >= 2 AND edits <= floor(longest / 2)").withColumn("r", F.rank().over(Window.partitionBy("id").orderBy(F.desc("shared"), F.desc("start"), "edits"))).where("r = 1")
    best = good.groupBy("id").agg(F.count("*").alias("n"), F.min("wrapper_id").alias("wrapper_id")).where("n = 1")
    return exact.unionByName(tokens).unionByName(best.select("id", "wrapper_id", F.lit("wrapper_name_approximate").alias("how")))


def resolve_usages(usages: DataFrame, catalog: DataFrame, wrappers: DataFrame, refs: DataFrame) -> DataFrame:
    """(id, file, catalog_file, table, key, wrapper_id, match_kind): what each use of a string means; unmatched without a record.

    usages (id, file, table, key, literal, wrapper_name); catalog (table, key, value, catalog_file, catalog_dir); wrappers
    (wrapper_id, wrapper_name, table, key); refs (id, wrapper_id): types that uses refer to. In turn: table and key; the
    literal as a key; wrappers referred to, whatever came before; then, only for those still without a match, wrappers
    by name and the wrapper's name as a key. Of several records of a key the nearest directories count, ties stay.
    """
    usages = usages.dropDuplicates(["id"])
    c = catalog.select(*RECORD)
    by_key = lambda df, t, k: df.join(c, (F.col(k) == c["key"]) if t is None else (F.col(t) == c["table"]) & (F.col(k) == c["key"]))
    none = F.lit(None).cast("string")
    u = usages.select("id", "file", F.col("table").alias("t"), F.col("key").alias("k"), "literal", "wrapper_name")
    pick = lambda df, kind, wrapper, asked: _nearest(df.select("id", "file", "catalog_file", "catalog_dir", c["table"], c["key"], wrapper.alias("wrapper_id"), kind.alias("match_kind"), asked.alias("asked"))).select(MATCH)
    direct = cut(pick(by_key(u.where("t IS NOT NULL"), "t", "k"), F.lit("direct_metadata"), none, F.lit("")), "l10n-direct")
    left = _open(u, direct).where("literal IS NOT NULL")
    literal = by_key(left.where("t IS NOT NULL"), "t", "literal").unionByName(by_key(left.where("t IS NULL"), None, "literal"))
    literal = cut(pick(literal, F.lit("literal_key"), none, F.lit("")), "l10n-literal")
    bound = wrappers.select("wrapper_id", F.col("table").alias("wt"), F.col("key").alias("wk"))
    symbol = cut(pick(by_key(u.join(refs.select("id", "wrapper_id").distinct(), "id").join(bound, "wrapper_id"), "wt", "wk"), F.lit("wrapper_symbol"), F.col("wrapper_id"), F.lit("")), "l10n-symbol")
    left = cut(_open(u, direct, literal, symbol).where("wrapper_name IS NOT NULL"), "l10n-left")
    named = left.join(wrappers_by_name(left, wrappers), "id").join(bound, "wrapper_id")
    named = cut(pick(by_key(named, "wt", "wk"), F.col("how"), F.col("wrapper_id"), F.lit("")), "l10n-named")
    left = _open(left, named).withColumn("wk", key_from_wrapper(F.col("wrapper_name")))
    keys = c.withColumn("plain", F.replace(phrase(F.col("key")), F.lit(" "), F.lit("_")))
    keyed = left.join(keys, (F.col("wk") == F.col("plain")) & (F.col("t").isNull() | (F.col("t") == keys["table"])))
    keyed = _nearest(keyed.select("id", "file", "catalog_file", "catalog_dir", keys["table"], keys["key"], none.alias("wrapper_id"), F.lit("wrapper_name_key").alias("match_kind"), F.lit("").alias("asked"))).select(MATCH)
    out = direct.unionByName(literal).unionByName(symbol).unionByName(named).unionByName(cut(keyed, "l10n-keyed"))
    lost = _open(u, out).select("id", "file", *[none.alias(x) for x in ("catalog_file", "table", "key", "wrapper_id")], F.lit("unmatched").alias("match_kind"))
    return out.unionByName(lost)


def records_named(catalog: DataFrame, text: str, table: str | None = None) -> DataFrame:
    """Catalog records of a key (in a table), with matched_by; if there are none, those whose value the text is."""
    by_key = catalog.where(F.col("key") == text)
    by_key = by_key if table is None else by_key.where(F.col("table") == table)
    if by_key.limit(1).count():
        return by_key.select(*RECORD, F.lit("key").alias("matched_by"))
    return catalog.where(F.lower("value") == text.lower()).select(*RECORD, F.lit("value").alias("matched_by"))


def l10n_usages(nodes: DataFrame, edges: DataFrame, usages: DataFrame, catalog: DataFrame, wrappers: DataFrame, text: str, table: str | None = None) -> DataFrame:
    """(catalog_file, table, key, id, match_kind): where the records that text names (a key, else a value) are used.

    Uses are those that resolve_usages() gives them, and callers of their wrappers, or of accessors that implement a
    wrapper, that are no uses or wrappers themselves (wrapper_caller). Of several catalogs with one key, a use stays with
    the nearest.
    """
    records = cut(records_named(catalog, text, table), "l10n-records")
    refs = edges.where("kind = 'type_ref'").select(F.col("source").alias("id"), F.col("target").alias("wrapper_id")).join(wrappers.select("wrapper_id"), "wrapper_id", "left_semi")
    direct = resolve_usages(usages, catalog, wrappers, refs).join(records.select("catalog_file", "table", "key", "catalog_dir"), ["catalog_file", "table", "key"])
    mine = wrappers.join(records.select("table", "key").distinct(), ["table", "key"]).select("wrapper_id", "table", "key")
    accessors = edges.where("kind = 'implements'").select(F.col("source").alias("entry"), F.col("target").alias("wrapper_id"))
    entries = cut(mine.select("wrapper_id", F.col("wrapper_id").alias("entry"), "table", "key").unionByName(mine.join(accessors, "wrapper_id").select("wrapper_id", "entry", "table", "key")), "l10n-entries")
    calls = edges.where("kind IN ('calls', 'uses')").select(F.col("source").alias("id"), F.col("target").alias("entry")).join(entries, "entry")
    calls = calls.join(entries.select("wrapper_id", F.col("entry").alias("id")), ["wrapper_id", "id"], "left_anti").join(usages.select("id"), "id", "left_anti").join(wrappers.select(F.col("wrapper_id").alias("id")), "id", "left_anti")
    calls = calls.join(nodes.select("id", "file"), "id").join(records.select("catalog_file", "table", "key", "catalog_dir"), ["table", "key"])
    rows = direct.select("catalog_file", "catalog_dir", "table", "key", "id", "file", "match_kind").unionByName(calls.select("catalog_file", "catalog_dir", "table", "key", "id", "file", F.lit("wrapper_caller").alias("match_kind")))
    one = rows.groupBy("catalog_file", "catalog_dir", "table", "key", "id", "file").agg(F.min("match_kind").alias("match_kind"))
    far = one.withColumn("far", directory_distance(dirname(F.col("file")), F.col("catalog_dir")))
    near = far.withColumn("r", F.rank().over(Window.partitionBy("table", "key", "id").orderBy("far"))).where("r = 1")
    return near.select("catalog_file", "table", "key", "id", "match_kind")
