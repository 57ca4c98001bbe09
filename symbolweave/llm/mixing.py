"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

Each source gets the repetition rate at which its bytes reach its share of the target; each document's number of
copies is a Poisson variate of that rate, found by inverting the distribution at a hash of (seed, doc_id). Copies are
exploded and dealt over all partitions by a hash of (seed, doc_id, copy), then ordered by it: a global shuffle.
A rate over CHUNK_RATE is drawn as a sum of independent variates of equal smaller rates, which is exact and keeps
exp(-rate) from underflowing.

Up to BROADCAST_SOURCES sources, their rates are broadcast; beyond, documents are salted before the join, so that a
source with a third of all rows is split.

Edge cases: columns named like those added stay as they are, whatever the case of their letters, and the added ones
take underscores; a null source is a source of its own; a null or empty text weighs one byte, as each text weighs its UTF-8
bytes plus one; rows that repeat a doc_id get equal counts; sources without a weight, or of weight 0, get no copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symbolweave.llm.common import fresh, quoted, save

#: The largest rate inverted at once, and the terms of its distribution: P(X >= 120) at rate 16 is below 2^-53.
CHUNK_RATE, TERMS = 16, 120
#: Up to so many sources, their rates (a distribution of TERMS doubles each, 1 KB) are broadcast; beyond, they are joined by shuffle.
BROADCAST_SOURCES, SALTS = 10_000, 16
NULL_SOURCE = "\u0000null"


def uniform(*parts: Column) -> Column:
    """52 bits of md5 as a double in [0, 1)."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, weights: dict[str, float] | None, epochs: float) -> DataFrame:
    """(mix_source, rate, draws, cdf) for each source; weights None: every source weighs the same."""
    size = (F.octet_length(F.coalesce(F.col("text"), F.lit(""))) + 1).cast("long")
    stats = docs.groupBy(F.coalesce(F.col("source").cast("string"), F.lit(NULL_SOURCE)).alias("mix_source")).agg(F.sum(size).alias("bytes"))
    stats = save(stats, "mix-sources")
    if weights is None:
        weight = F.lit(1.0)
    else:
        given = [x for k, v in weights.items() for x in (F.lit(k if k is not None else NULL_SOURCE), F.lit(float(v)))]
        weight = F.coalesce(F.try_element_at(F.create_map(*given), F.col("mix_source")), F.lit(0.0)) if given else F.lit(0.0)
    stats = stats.withColumn("weight", weight)
    all_ = stats.agg(F.sum("bytes").alias("total"), F.sum("weight").alias("weights")).first()
    total, weights_sum = float(all_["total"] or 0), float(all_["weights"] or 0) or 1.0
    rate = F.lit(epochs) * F.col("weight") * F.lit(total) / (F.lit(weights_sum) * F.col("bytes"))
    rates = stats.select("mix_source", rate.alias("rate"))
    rates = rates.withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / CHUNK_RATE)).cast("int"))
    first = F.exp(-F.col("rate") / F.col("draws"))
    start = F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("cdf"))

    def step(a, k):
        p = a["p"] * (F.col("rate") / F.col("draws")) / k
        return F.struct(p.alias("p"), (a["c"] + p).alias("c"), F.array_append(a["cdf"], a["c"] + p).alias("cdf"))

    return rates.withColumn("cdf", F.aggregate(F.sequence(F.lit(1), F.lit(TERMS - 1)), start, step, lambda a: a["cdf"]))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, seed: str = "mix-1") -> DataFrame:
    """docs (doc_id, text, source) replicated to weights: its columns, then copy, copies, rate, mix_key.

    epochs: bytes of the result over bytes of docs. copy counts from 1 to copies.
    """
    columns = docs.columns
    src, rate, draws, cdf, salt, copies, copy, key = (fresh(docs, x) for x in ("mix_source", "rate", "mix_draws", "mix_cdf", "mix_salt", "copies", "copy", "mix_key"))
    rates = save(source_rates(docs, weights, epochs), "mix-rates")
    few = rates.count() <= BROADCAST_SOURCES
    rates = rates.select(F.col("mix_source").alias(src), F.col("rate").alias(rate), F.col("draws").alias(draws), F.col("cdf").alias(cdf))
    sourced = docs.withColumn(src, F.coalesce(F.col("source").cast("string"), F.lit(NULL_SOURCE)))
    if few:
        rated = sourced.join(F.broadcast(rates), src)
    else:
        dealt = sourced.withColumn(salt, F.pmod(F.xxhash64("doc_id", "text"), F.lit(SALTS)).cast("int"))
        rated = dealt.join(rates.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [src, salt])
    # each variate is made once, then compared with the whole distribution
    variates = F.transform(F.sequence(F.lit(1), F.col(draws)), lambda i: uniform(F.lit(seed), F.col("doc_id"), i))
    count = F.aggregate(variates, F.lit(0), lambda n, u: n + F.size(F.filter(F.col(cdf), lambda c: c <= u)))
    counted = rated.withColumn(copies, count).where(F.col(copies) > 0)
    out = counted.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies))))
    out = out.withColumn(key, F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col(copy).cast("string"), F.lit("order")).cast("binary")))
    out = out.select(*quoted(columns), F.col(copy), F.col(copies), F.col(rate), F.col(key))
    return out.repartition(F.col(key)).sortWithinPartitions(key)


#: Fixed weights of the query: none are named, so each source gets an equal share of the bytes.
ORACLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, lang, text, source, coalesce(source, chr(0) || 'null') AS src, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size FROM documents),
s AS (SELECT src, CAST(sum(size) AS BIGINT) AS bytes FROM d GROUP BY src),
a AS (SELECT CAST(sum(bytes) AS DOUBLE) AS total, CAST(count(*) AS DOUBLE) AS weights FROM s),
r AS (SELECT src, CAST(1.0 AS DOUBLE) * CAST(1.0 AS DOUBLE) * total / (weights * bytes) AS rate FROM s, a),
q AS (SELECT src, rate, CAST(greatest(1, ceil(rate / {CHUNK_RATE})) AS INTEGER) AS draws FROM r),
c AS (SELECT src, 0 AS k, exp(-rate / draws) AS p, exp(-rate / draws) AS cum, rate / draws AS mu FROM q
  UNION ALL SELECT src, k + 1, p * mu / (k + 1), cum + p * mu / (k + 1), mu FROM c WHERE k + 1 < {TERMS}),
u AS (SELECT doc_id, src, rate, t.i, CAST(CAST('0x' || substr(md5('mix-1|' || doc_id || '|' || t.i), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u
  FROM d JOIN q USING (src), unnest(range(1, draws + 1)) AS t(i)),
n AS (SELECT u.doc_id, u.rate, count(c.k) AS copies FROM u JOIN c ON c.src = u.src AND c.cum <= u.u GROUP BY u.doc_id, u.rate)
SELECT d.doc_id, d.source, d.lang, d.text, CAST(t.j AS INTEGER) AS copy, CAST(n.copies AS INTEGER) AS copies, n.rate AS rate,
  md5('mix-1|' || d.doc_id || '|' || t.j || '|order') AS mix_key
FROM n JOIN d USING (doc_id), unnest(range(1, n.copies + 1)) AS t(j)
"""
