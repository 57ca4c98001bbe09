"""Approximate nearest neighbours by additive quantisation.

Codebooks hold full-dimensional codewords, fitted stage by stage on residuals of a bounded sample. Every vector is
encoded by beam search over all codebooks (a vector is approximated by the sum of one codeword from each) and its norm
and that of its approximation are stored. A query scores all codes through its table of inner products with every
codeword, brought to the vector's own length by the stored norms; the best of each block are reranked exactly on the
original vectors, in double precision.

Vectors and queries meet in blocks (BLOCK vectors by QUERIES queries), so no task holds more than a block of each; each
pair of blocks returns k rows a query, merged by a window. Every query meets every code: the work is the stated queries
times all rows. Edge cases: vectors null, zero, holding null or non-finite components, or of another length than the
most common one, take no part, nor do null ids; ties go to the smaller vec_id; of equal ids each row counts as a
candidate but never for its own id, and each is a query of its own, with ranks of its own; with fewer candidates than
k, all return; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symbolweave.llm.common import save

#: Codebooks, codewords in each, beam width, vectors of the sample that codebooks are fitted on, Lloyd steps a codebook.
BOOKS, WORDS, BEAM, SAMPLE, STEPS = 16, 256, 4, 8192, 6
#: Vectors and queries in a block, and how many of a block are reranked exactly for each query.
BLOCK, QUERIES, RERANK = 4096, 256, 128


def usable(vectors: DataFrame, vec: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>) of the vectors that take part."""
    v = F.transform(F.col(vec), lambda x: x.cast("double"))
    ok = F.forall(F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(F.col("v"), lambda x: x != 0)
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ok)
    top = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return good.where(F.size("v") == (top["n"] if top else 0))


def fit_codebooks(x: np.ndarray, books: int = BOOKS, words: int = WORDS, steps: int = STEPS, seed: int = 1) -> np.ndarray:
    """books x words x d: k-means on what the codebooks before leave over."""
    rng, out, rest = np.random.default_rng(seed), [], x.copy()
    words = min(words, len(x))
    for _ in range(books):
        c = rest[rng.choice(len(rest), words, replace=False)].copy()
        for step in range(steps + 1):
            near = np.argmin((c**2).sum(1) - 2 * rest @ c.T, axis=1)
            if step < steps:
                n = np.bincount(near, minlength=words)
                total = np.zeros_like(c)
                np.add.at(total, near, rest)
                c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], rest[rng.choice(len(rest), words)])
        out.append(c)
        rest = rest - c[near]
    return np.stack(out)


def encode(x: np.ndarray, codebooks: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Codes (n x books, uint8) by beam search, and squared norms of the approximations."""
    m, k, d = codebooks.shape
    flat = codebooks.reshape(m * k, d)
    dots, own = (x @ flat.T).reshape(len(x), m, k), (flat**2).sum(1).reshape(m, k)
    cross = (flat @ flat.T).reshape(m, k, m, k)
    codes, cost = np.zeros((len(x), 1, 0), np.int64), np.zeros((len(x), 1))  # cost: |approximation|^2 - 2 x.approximation
    for j in range(m):
        with_past = np.zeros((len(x), codes.shape[1], k))
        for i in range(j):
            with_past += cross[i, codes[:, :, i], j]
        grown = (cost[:, :, None] + own[j] - 2 * dots[:, j][:, None, :] + 2 * with_past).reshape(len(x), -1)
        keep = min(beam, grown.shape[1])
        best = np.argpartition(grown, keep - 1, axis=1)[:, :keep]
        cost = np.take_along_axis(grown, best, 1)
        codes = np.concatenate((np.take_along_axis(codes, (best // k)[:, :, None], 1), (best % k)[:, :, None]), 2)
    pick = cost.argmin(1)
    codes = codes[np.arange(len(x)), pick]
    approx = sum(codebooks[j][codes[:, j]] for j in range(m))
    return codes.astype(np.uint8), (approx**2).sum(1)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def _index_blocks(codebooks: np.ndarray, block: int):
    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, block):
                part = b.slice(lo, block)
                ids, x = np.array(part.column("vec_id")), _matrix(part.column("v"))
                order = np.argsort(ids, kind="stable")
                ids, x = ids[order], x[order]
                found = [encode(x[i : i + 512], codebooks) for i in range(0, len(x), 512)]
                codes, norms = np.concatenate([f[0] for f in found]), np.sqrt(np.stack([(x**2).sum(1), np.concatenate([f[1] for f in found])]))
                row = [[a.tobytes()] for a in (ids.astype("<i8"), codes, norms, x)]
                yield pa.RecordBatch.from_arrays([pa.array(r, pa.binary()) for r in row], ["ids", "codes", "norms", "vectors"])

    return run


def build_index(good: DataFrame, codebooks: np.ndarray, block: int) -> DataFrame:
    """A row a block of vectors: ids, codes, norms (the vectors', then the approximations'), vectors as bytes."""
    n = good.count()
    dealt = good.repartition(max(1, -(-n // block)))
    return save(dealt.mapInArrow(_index_blocks(codebooks, block), "ids binary, codes binary, norms binary, vectors binary"), "ann-index")


def _query_blocks(size: int):
    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, size):
                part = b.slice(lo, size)
                cols = [[np.array(part.column(c)).astype("<i8").tobytes()] for c in ("vec_id", "place")] + [[_matrix(part.column("v")).tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in cols], ["query_ids", "places", "queries"])

    return run


def search_block(ids, codes, norms, x, query_ids, queries, codebooks, k, rerank):
    """(query index, vector index, exact inner product) of each query's k best of the block."""
    m = codebooks.shape[0]
    tables = np.einsum("qd,mkd->qmk", queries, codebooks)
    approx = np.zeros((len(queries), len(ids)))
    for j in range(m):
        approx += tables[:, j][:, codes[:, j]]
    approx *= norms[0] / np.maximum(norms[1], np.finfo(float).tiny)
    approx[query_ids[:, None] == ids[None, :]] = -np.inf
    r = min(rerank, len(ids))
    if r < len(ids):
        # the r best; of those that tie for the last places, the ones with the smallest ids (the block is in their order)
        last = np.partition(approx, len(ids) - r, axis=1)[:, len(ids) - r]
        above, level = approx > last[:, None], approx == last[:, None]
        level &= np.cumsum(level, axis=1) <= (r - above.sum(1))[:, None]
        near = np.nonzero(above | level)[1].reshape(len(queries), r)
    else:
        near = np.tile(np.arange(len(ids)), (len(queries), 1))
    exact = np.stack([(x[near[i]] * queries[i]).sum(1) for i in range(len(queries))])
    exact[query_ids[:, None] == ids[near]] = -np.inf
    best = np.lexsort((near, -exact), axis=1)[:, :k]
    q = np.repeat(np.arange(len(queries)), best.shape[1])
    hit, s = np.take_along_axis(near, best, 1).ravel(), np.take_along_axis(exact, best, 1).ravel()
    keep = s > -np.inf
    return q[keep], hit[keep], s[keep]


def _search(codebooks: np.ndarray, k: int, rerank: int):
    m, _, d = codebooks.shape

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                ids, qids, places = (np.frombuffer(row[c], "<i8") for c in ("ids", "query_ids", "places"))
                norms = np.frombuffer(row["norms"]).reshape(2, -1)
                codes = np.frombuffer(row["codes"], np.uint8).reshape(-1, m)
                x, q = np.frombuffer(row["vectors"]).reshape(-1, d), np.frombuffer(row["queries"]).reshape(-1, d)
                qi, vi, s = search_block(ids, codes, norms, x, qids, q, codebooks, k, rerank)
                yield pa.RecordBatch.from_arrays([pa.array(qids[qi]), pa.array(places[qi]), pa.array(ids[vi]), pa.array(s)], ["query_id", "place", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, is_query, k: int = 20, vec: str = "embedding", sample: int = SAMPLE, rerank: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k vectors of largest inner product with each row that is_query selects."""
    good = save(usable(vectors, vec), "ann-vectors")
    schema = "query_id long, place long, vec_id long, score double"
    drawn = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()
    if drawn.num_rows == 0:
        return good.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    codebooks = fit_codebooks(_matrix(drawn.column("v").combine_chunks()))
    index = build_index(good, codebooks, BLOCK)
    queries = good.where(is_query).withColumn("place", F.monotonically_increasing_id())
    queries = queries.repartition(max(1, -(-queries.count() // QUERIES)))
    queries = save(queries.mapInArrow(_query_blocks(QUERIES), "query_ids binary, places binary, queries binary"), "ann-queries")
    # rows of both sides are blocks: each block of the stated queries meets each block of vectors once
    pairs = index.crossJoin(queries)
    found = pairs.mapInArrow(_search(codebooks, k, rerank or RERANK), schema)
    w = Window.partitionBy("query_id", "place").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
