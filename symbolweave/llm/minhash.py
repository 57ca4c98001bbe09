"""MinHash near-dedup by tensored banding.

Two small collections of SIDE half keys, each of ROWS minhashes, are computed for a document; every pair of half keys,
one from either collection, is the key of one of SIDE*SIDE tables. So 2*SIDE*ROWS minhashes stand in for the
SIDE*SIDE*2*ROWS that independent tables would need, about the square root. At similarity 0.8 a pair misses every table with
probability 2 * (1 - 0.8^ROWS)^SIDE = 0.16 %, at 0.85 0.03 %.

Rows of equal shingle sets form a class with an id of its own; only classes enter tables. In a table a class is first compared with the most
central class of its bucket (the one whose buckets are fullest), which joins most buckets into one component in linear
work. What a bucket then still holds of different components is compared across components, less the pairs whose sizes
or distances from the bucket's centre (triangle inequality), or parity sketches (a lower bound of how many shingles they
don't share) rule out a link. None of these loses a link. Every link is confirmed on full sets.

Edge cases: null, empty and wordless texts have no shingles, link with nothing and are kept; with fewer words than a
shingle the whole sequence is one; a null doc_id takes no part and is kept; rows that repeat a doc_id are one document
to the components (whatever one of its texts links with, all of it does), their shingles counted row by row. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symbolweave.llm.common import mix64, runs, save, tidy, words

ROWS, SIDE = 2, 7
#: Longs of a set's parity sketch: bit i says whether an odd number of its hashes fall on i. Two sets differ in at least as many elements as their sketches in bits.
SKETCH = 16
#: Ids up to this many (16 MB) are broadcast to fetch or drop documents; beyond, they are joined by shuffle.
BROADCAST_IDS = 1_000_000
_rng = np.random.default_rng(77)
ODD = _rng.integers(1, 1 << 63, 2 * SIDE * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _rng.integers(0, 1 << 63, 2 * SIDE * ROWS, dtype=np.uint64)


def shingle_sets(texts: list, k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the k-word shingles of each text."""
    h, n = words(texts)
    grams = np.zeros(max(len(h) - k + 1, 0), np.uint64)
    for i in range(k):
        grams = grams * np.uint64(0xD1342543DE82EF95) + h[i : i + len(grams)]
    grams = mix64(grams)
    out, at = [], 0
    for c in n.tolist():
        if c >= k:
            out.append(np.unique(grams[at : at + c - k + 1]))
        elif c:
            x = np.uint64(c)
            for w in h[at : at + c]:
                x = np.uint64((int(x) * 0xD1342543DE82EF95 + int(w)) & 0xFFFFFFFFFFFFFFFF)
            out.append(mix64(np.array([x], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out


def half_keys(sets: list[np.ndarray]) -> np.ndarray:
    """For each non-empty set the 2*SIDE half keys, each from ROWS minhashes."""
    flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((len(sets), 2 * SIDE), np.uint64)
    for j in range(2 * SIDE):
        key = np.full(len(sets), j, np.uint64)
        for r in range(ROWS):
            i = j * ROWS + r
            key = mix64(key * np.uint64(0x2545F4914F6CDD1D) + np.minimum.reduceat(flat * ODD[i] + ADD[i], starts))
        out[:, j] = key
    return out


def fingerprints(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, from two sums that don't depend on order."""
    a, b = mix64(s + np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64), mix64(s ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64)
    return int(np.int64(a)), int(np.int64(b))


def parity_sketch(s: np.ndarray) -> list[int]:
    odd = np.bincount((s >> np.uint64(20) & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8").tolist()


def _sign(k: int):
    def run(batches):
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            for lo, texts in runs(b.column("text")):
                sets = shingle_sets(texts, k)
                full = [s for s in sets if len(s)]
                keys = iter(half_keys(full).view(np.int64).tolist() if full else [])
                prints = [fingerprints(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[lo : lo + len(texts)], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([p[0] for p in prints]),
                     pa.array([p[1] for p in prints]), pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64())),
                     pa.array([parity_sketch(s) if len(s) else None for s in sets], pa.list_(pa.int64()))],
                    ["doc_id", "n", "f1", "f2", "halves", "sketch"],
                )

    return run


def _fetch(k: int):
    def run(batches):
        for b in batches:
            for _, texts in runs(b.column("text")):
                sets = [s for s in shingle_sets(texts, k) if len(s)]
                prints = [fingerprints(s) for s in sets]
                cols = [pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["f1", "f2", "n", "set"])

    return run


def _common(batches):
    for b in batches:
        both = zip(b.column("set_a").to_pylist(), b.column("set_b").to_pylist(), strict=True)
        n = [len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in both]
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), b.column("na"), b.column("nb"), pa.array(n, pa.int64())], ["a", "b", "na", "nb", "common"])


def _only(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """docs whose doc_id is (left_semi) or is not (left_anti) among ids (one column, id)."""
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, docs["doc_id"] == ids["id"], how)


def confirm(docs: DataFrame, classes: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """pairs of classes (a, b, na, nb) with common: how many shingles both have."""
    pairs = save(pairs, "near-pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    wanted = save(classes.join(ids, "class", "left_semi").select("class", "f1", "f2", "n", F.col("doc_id").alias("id")), "near-ids")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    # a doc_id may have other texts too: the set itself says whose class it is
    found = _only(texts, wanted.select("id").distinct(), "left_semi").mapInArrow(tidy(_fetch(k)), "f1 long, f2 long, n long, set binary")
    sets = save(found.join(wanted.select("class", "f1", "f2", "n"), ["f1", "f2", "n"]).select("class", "set").dropDuplicates(["class"]), "near-sets")
    both = pairs.join(sets.select(F.col("class").alias("b"), F.col("set").alias("set_b")), "b")
    both = both.join(sets.select(F.col("class").alias("a"), F.col("set").alias("set_a")), "a").select("a", "b", "na", "nb", "set_a", "set_b")
    return save(both.mapInArrow(tidy(_common), "a long, b long, na long, nb long, common long"), "near-confirmed")


def linked(percent: int):
    return F.col("common") * 100 >= (F.col("na") + F.col("nb") - F.col("common")) * percent


def components(links: DataFrame) -> DataFrame:
    """(id, component) of the ids in links (a, b): the smallest id reachable, by propagating smallest labels with shortcuts."""
    both = save(links.select("a", "b").union(links.select("b", "a")).distinct(), "near-links")
    label = save(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.min("a")).alias("component")), "near-labels")
    while True:
        seen = both.join(label.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        lower = label.join(seen, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        # a shortcut: the label of the label
        up = label.select(F.col("id").alias("component"), F.col("component").alias("up"))
        step = save(lower.join(up, "component", "left").select("id", "old", F.least("component", F.coalesce("up", "component")).alias("component")), "near-labels")
        if step.where("component < old").limit(1).count() == 0:
            return step.select("id", "component")
        label = step.select("id", "component")


def _same_document(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): classes that hold rows of one doc_id."""
    again = save(sets.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("doc_id"), "near-again")
    rows = sets.select("doc_id", "f1", "f2", "n").join(again, "doc_id", "left_semi").distinct()
    held = rows.join(classes.select("class", "f1", "f2", "n"), ["f1", "f2", "n"]).select("doc_id", "class")
    least = held.groupBy("doc_id").agg(F.min("class").alias("a"))
    return held.join(least, "doc_id").where("a < class").select("a", F.col("class").alias("b")).distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: links are 100 * common shingles >= percent * shingles of either."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")
    signed = save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(tidy(_sign(k)), "doc_id long, n long, f1 long, f2 long, halves array<long>, sketch array<long>"), "near-signatures")
    sets = signed.where("n > 0 AND doc_id IS NOT NULL")
    kinds = sets.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("doc_id"), F.first("halves").alias("halves"), F.first("sketch").alias("sketch"))
    classes = save(kinds.withColumn("class", F.monotonically_increasing_id()), "near-classes")
    half = F.col("halves")
    keys = F.array(*[F.xxhash64(F.lit(i * SIDE + j), half[i], half[SIDE + j]) for i in range(SIDE) for j in range(SIDE)])
    rows = classes.select("class", "n", F.explode(keys).alias("key"))
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = save(rows.join(shared, "key"), "near-members")
    weights = members.groupBy("class").agg(F.sum("size").alias("weight")).join(classes.select("class", "doc_id"), "class")
    weighted = members.join(weights, "class")
    # of equally full buckets, the smallest doc_id: copies come after what they are copied from
    centres = weighted.groupBy("key").agg(F.max(F.struct("weight", (-F.col("doc_id")).alias("minus"), "class", "n")).alias("c"))
    centres = save(centres.select("key", F.col("c.class").alias("centre"), F.col("c.n").alias("centre_n")), "near-centres")
    sizes = lambda x, y: (F.least(x, y) * 100 >= F.greatest(x, y) * percent)
    star = members.join(centres, "key").where(F.col("class") != F.col("centre"))
    pairs = star.select(F.least("class", "centre").alias("a"), F.greatest("class", "centre").alias("b"),
                        F.when(F.col("class") < F.col("centre"), F.col("n")).otherwise(F.col("centre_n")).alias("na"),
                        F.when(F.col("class") < F.col("centre"), F.col("centre_n")).otherwise(F.col("n")).alias("nb")).distinct()
    tested = confirm(docs, classes, pairs.where(sizes(F.col("na"), F.col("nb"))), k)
    links = tested.where(linked(percent)).select("a", "b").unionByName(_same_document(sets, classes))
    found = components(links)
    # second round: members of one bucket in different components
    far = F.lit(1.0) - F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))
    apart = tested.select("a", "b", far.alias("far")).union(tested.select("b", "a", far.alias("far")))
    apart = apart.toDF("centre", "class", "far")
    placed = members.join(found.withColumnRenamed("id", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    split = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    rest = placed.join(split, "key").join(centres.select("key", "centre"), "key").join(apart, ["centre", "class"], "left")
    rest = rest.withColumn("far", F.when(F.col("class") == F.col("centre"), F.lit(0.0)).otherwise(F.col("far")))
    rest = save(rest.select("key", "class", "n", "component", "far", "centre").join(classes.select("class", "sketch"), "class"), "near-rest")
    x, y = rest.alias("x"), rest.alias("y")
    reach = F.lit(1 - percent / 100 + 1e-9)
    near = F.abs(F.col("x.far") - F.col("y.far")) <= reach
    differ = reduce(add, [F.bit_count(F.col("x.sketch")[i].bitwiseXOR(F.col("y.sketch")[i])) for i in range(SKETCH)])
    alike = differ * (100 + percent) <= (F.col("x.n") + F.col("y.n")) * (100 - percent)
    more = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.class") < F.col("y.class")) & (F.col("x.component") != F.col("y.component"))
                  & (F.col("x.class") != F.col("x.centre")) & (F.col("y.class") != F.col("y.centre")) & F.coalesce(near, F.lit(True)) & sizes(F.col("x.n"), F.col("y.n")) & alike)
    more = more.select(F.col("x.class").alias("a"), F.col("y.class").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb")).distinct()
    more = confirm(docs, classes, more.join(tested, ["a", "b"], "left_anti"), k).where(linked(percent)).select("a", "b")
    if more.limit(1).count():
        found = components(links.unionByName(more))
    labelled = classes.select("f1", "f2", "n", "class", "doc_id").join(found.withColumnRenamed("id", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    first = labelled.groupBy("component").agg(F.min("doc_id").alias("name"))
    named = save(labelled.join(first, "component").select("f1", "f2", "n", F.col("name").alias("component")), "near-named")
    out = signed.select("doc_id", "n", "f1", "f2").join(named, ["f1", "f2", "n"], "left")
    own = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each component: that of the smallest doc_id (all its rows, where a doc_id repeats)."""
    lost = near_duplicates(docs, k, percent).where(~F.col("kept")).select(F.col("doc_id").alias("id")).distinct()
    return _only(docs, save(lost, "near-lost"), "left_anti")
