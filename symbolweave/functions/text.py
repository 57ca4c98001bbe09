"""Scalar text functions of the operators, all as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_accessor(name: Column) -> Column:
    return name.rlike("^(getter|setter):")


def symbol_name(name: Column) -> Column:
    """Without an accessor's prefix and without anything from an opening bracket on."""
    return F.regexp_replace(F.regexp_replace(name, "^(getter|setter):", ""), r"\(.*$", "")


def effect_component(x: Column) -> Column:
    """Lower-case letters, digits and underscores; unknown if nothing is left."""
    plain = F.regexp_replace(F.lower(symbol_name(x)), "[^a-z0-9]", "_")
    trimmed = F.regexp_replace(plain, "^_+|_+$", "")
    return F.when(trimmed == "", "unknown").otherwise(trimmed)


def split_words(x: Column) -> Column:
    """A space at each lower-upper, letter-digit and digit-letter boundary and for each other character."""
    for pattern in ("([a-z])([A-Z])", "([A-Za-z])([0-9])", "([0-9])([A-Za-z])"):
        # twice, as matches of one pass don't overlap
        x = F.regexp_replace(F.regexp_replace(x, pattern, "$1 $2"), pattern, "$1 $2")
    return F.trim(F.regexp_replace(x, "[^A-Za-z0-9]+", " "))


def search_terms(*parts: Column) -> Column:
    """Sorted distinct lower-case terms of all parts."""
    text = F.lower(split_words(F.concat_ws(" ", *parts)))
    return F.array_sort(F.array_distinct(F.filter(F.split(text, " "), lambda t: t != "")))


def phrase(x: Column) -> Column:
    return F.lower(split_words(x))


def key_from_wrapper(name: Column) -> Column:
    """A wrapper's name as a catalog key: words joined by underscores."""
    return F.replace(phrase(name), F.lit(" "), F.lit("_"))


def camel(x: Column, upper: bool = False) -> Column:
    words = F.split(phrase(x), " ")
    joined = F.array_join(F.transform(words, F.initcap), "")
    return joined if upper else F.concat(F.lower(F.substring(joined, 1, 1)), F.substring(joined, 2, 100_000))


def basename(file: Column) -> Column:
    return F.substring_index(file, "/", -1)


def dirname(file: Column) -> Column:
    """Up to and with the last slash; empty without one."""
    return F.regexp_extract(file, "^(.*/)", 1)


def directory_distance(a: Column, b: Column) -> Column:
    """Steps up from one directory and down to the other."""
    parts = lambda x: F.filter(F.split(x, "/"), lambda p: p != "")
    x, y = parts(a), parts(b)
    same = F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False)))
    run = F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, e: F.struct((s["n"] + (s["on"] & e).cast("int")).alias("n"), (s["on"] & e).alias("on")), lambda s: s["n"])
    return F.size(x) + F.size(y) - 2 * run


def glob_regex(pattern: str) -> str:
    """A search glob as a regular expression: without * or ? a suffix; case and \\ or / don't matter."""
    import re

    body = re.escape(pattern.replace("\\", "/").lower())
    if "*" not in pattern and "?" not in pattern:
        return f"{body}$"
    return "^" + body.replace(r"\*", ".*").replace(r"\?", ".") + "$"


def layer_regex(pattern: str) -> str:
    """A layer pattern: plain text is the whole or a path's tail; with * or ? it may also start after any slash. Case and \\ or / don't matter."""
    import re

    body = re.escape(pattern.replace("\\", "/").lower()).replace(r"\*", ".*").replace(r"\?", ".")
    return rf"(?s)^(?:.*/)?{body}\z"


def doc_summary(doc: Column) -> Column:
    """A doc comment without its markers on one line; over 180 bytes, its first 177 characters and dots."""
    bare = lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")
    lines = F.transform(F.split(doc, "\n"), lambda s: bare(F.regexp_replace(bare(s), r"^(?:///)*(?://!)*(?:/\*\*)*(?:/\*)*\**|(?:\*/)+$", "")))
    text = F.array_join(F.filter(lines, lambda s: s != ""), " ")
    return F.when(F.octet_length(text) > 180, F.concat(F.substring(text, 1, 177), F.lit("..."))).otherwise(text)


def init_labels(name: Column) -> Column:
    """How many labels an initialiser's name, init(...), has."""
    return F.size(F.filter(F.split(F.regexp_extract(name, r"^init\((.*)\)$", 1), ":"), lambda x: x != ""))
