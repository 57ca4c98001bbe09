"""Nulls, empty and long texts, repeated rows, empty tables and clashing column names."""

import pytest
from pyspark.sql import functions as F

from symbolweave.llm import ann, exact_dedup, language_model, minhash, mixing, packing, quality, sharding, suffix_dedup, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, copy int, mix_key string, block long, `key` string"
LONG = " ".join(f"word{i % 977}" for i in range(60_000))


def odd(spark):
    rows = [(1, None), (2, ""), (3, "one two"), (3, "one two"), (4, "one two"), (None, "one two"), (5, LONG), (6, LONG), (7, " \t\n"), (8, "é %%% A  B   c "), (None, None)]
    return spark.createDataFrame([(i, t, None, None if i == 5 else "s", None, 0.5, 9, "k", 7, "x") for i, t in rows], SCHEMA)


def labels(spark):
    return spark.createDataFrame([(2, 0, 0), (3, 1, 0), (3, 0, None), (4, 1, 0), (6, 1, None), (8, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")


ROWWISE = {
    "exact": lambda d, s: exact_dedup.exact_duplicates(d),
    "quality": lambda d, s: quality.classify(d, labels(s)),
    "suffix": lambda d, s: suffix_dedup.repeated_spans(d),
    "lm": lambda d, s: language_model.lm_scores(d),
    "shards": lambda d, s: sharding.shard_by_bytes(d),
    "near": lambda d, s: minhash.near_duplicates(d),
}


@pytest.mark.parametrize("name", ROWWISE)
def test_a_row_for_each_row(spark, name):
    docs = odd(spark)
    got = ROWWISE[name](docs, spark).collect()
    ids = sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in got)
    assert ids == [-1, -1, 1, 2, 3, 3, 4, 5, 6, 7, 8]
    assert ROWWISE[name](docs.limit(0), spark).collect() == []
    if name == "exact":
        kept = {(r["keep_id"], r["group_size"]) for r in got if r["kept"]}
        assert kept == {(2, 3), (4, 4), (6, 2), (7, 1), (8, 1)}
    if name == "near":
        assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"]} == {1: 1, 2: 2, 3: 3, 4: 3, 5: 5, 6: 5, 7: 7, 8: 8}
    if name == "suffix":
        assert {r["doc_id"]: r["n_removed"] for r in got if r["doc_id"] in (6, 8)} == {6: len(LONG), 8: 0}


@pytest.mark.parametrize("stage", [exact_dedup.drop_exact_duplicates, minhash.drop_near_duplicates, lambda d: quality.keep_good(d, labels(d.sparkSession))])
def test_stages_keep_the_columns(spark, stage):
    docs = odd(spark)
    out = stage(docs)
    assert out.columns == docs.columns
    out.collect()
    assert stage(docs.limit(0)).collect() == []


def test_mixing(spark):
    docs = odd(spark)
    out = mixing.mix_sources(docs, epochs=2.0)
    assert out.columns == [*docs.columns, "copy_", "copies", "rate", "mix_key_"]
    assert {r["source"] for r in out.collect()} <= {None, "s"}
    assert mixing.mix_sources(docs.limit(0)).collect() == []
    assert mixing.mix_sources(docs, {"s": 0.0}).collect() == []


def test_packing(spark):
    got = packing.pack(odd(spark), seq_len=64, with_ids=True).collect()
    assert sum(r["length"] for r in got if r["doc_id"] == 2) == 1
    assert all(len(r["ids"]) == 4 * r["length"] for r in got)
    assert packing.pack(odd(spark).limit(0)).collect() == []


@pytest.mark.parametrize("text", ["a  b", " a", "a ", "a \n b", "  x 　 y", "don't stop 'll 12 3", "x\u0085 y", "tab\t z", "<|endoftext|> a <|endoftext|>"])
def test_word_encoder_equals_the_tokenizer(text):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoder = packing.TextEncoder(packing.vocabulary_path(), packing.added_tokens())
    assert np.frombuffer(encoder.encode(text), encoder.dtype).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x", "a  <|endoftext|>  b ", "<|endoftext| > <|endoftext", "plain text  here"])
def test_added_tokens_keep_their_ids(spark, text):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids
    (row,) = packing.pack(spark.createDataFrame([(1, text)], "doc_id long, text string"), with_ids=True).collect()
    assert np.frombuffer(row["ids"], "<u4").tolist() == [*want, packing.END_ID]


def test_bloom_passes_unique_rows_and_never_loses_a_repeat(spark):
    rows = spark.range(4000).select(F.xxhash64((F.col("id") / 2).cast("long") * (F.col("id") < 400).cast("long") + F.col("id") * (F.col("id") >= 400).cast("long")).alias("h"))
    rows = exact_dedup.save(rows.withColumn("row", F.monotonically_increasing_id()), "test-hashes")
    for bits in (1 << 20, 1 << 15):  # one filter, and two filters of 32,768 bits for a part of the hashes each
        flags = exact_dedup.flagged(rows, bits).groupBy("h").agg(F.count("*").alias("n"), F.max("maybe").alias("maybe")).collect()
        assert sum(r["n"] for r in flags) == 4000 and all(r["maybe"] for r in flags if r["n"] > 1)
        assert sum(r["maybe"] for r in flags if r["n"] == 1) < 120


@pytest.mark.parametrize("bits", [1 << 28, 1 << 15])
def test_exact_duplicates_in_parts(spark, bits):
    docs = spark.range(6000).selectExpr("id AS doc_id", "concat('t', IF(id % 3 = 0, 0, IF(id % 2 = 0, id % 900, id))) AS text", "id AS `a.b`")
    want = {}
    for r in docs.collect():
        want.setdefault(r["text"], []).append(r["doc_id"])
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_duplicates(docs, bits).collect()}
    assert got == {d: (max(g), len(g), d == max(g)) for g in want.values() for d in g}
    kept = exact_dedup.drop_exact_duplicates(docs, bits).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(max(g) for g in want.values()) and all(r["a.b"] == r["doc_id"] for r in kept)


@pytest.mark.parametrize("few", [True, False])
def test_added_columns_leave_others_alone(spark, monkeypatch, few):
    """Columns that differ from the added ones in case only, and names with a dot."""
    names = ["doc_id", "text", "source", "Copies", "MIX_KEY", "Rate", "URL_Host", "Score", "Exact_H", "a.b"]
    docs = spark.createDataFrame([(i, f"some words of text {i}", "s", 7, "mine", 1, "h", 2, 3, 4) for i in range(20)], ", ".join(f"`{n}` {'string' if n in ('text', 'source', 'MIX_KEY', 'URL_Host') else 'long'}" for n in names))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 10 if few else 0)
    mixed = mixing.mix_sources(docs, epochs=3.0)
    assert mixed.columns == [*names, "copy", "copies_", "rate_", "mix_key_"]
    rows = mixed.toArrow().to_pylist()
    assert len(rows) > 30 and all((r["Copies"], r["MIX_KEY"], r["Rate"]) == (7, "mine", 1) for r in rows)
    for out in (exact_dedup.drop_exact_duplicates(docs), quality.keep_good(docs, labels(spark)), minhash.drop_near_duplicates(docs)):
        assert out.columns == names
        assert all((r["Copies"], r["Score"], r["Exact_H"], r["a.b"]) == (7, 2, 3, 4) for r in out.toArrow().to_pylist())
    captures = docs.withColumns({"url": F.lit("http://x.org"), "fetched_at": F.to_timestamp_ntz(F.lit("2024-01-05"))})
    out = url_filter.filter_urls(captures, spark.createDataFrame([("X.org.", "add"), ("x.org", None)], "domain string, action string").withColumn("listed_at", F.to_timestamp_ntz(F.lit("2024-01-01"))))
    assert all(r["URL_Host"] == "h" and r["url_host_"] == "x.org" and r["blocked"] for r in out.toArrow().to_pylist())


@pytest.mark.parametrize(("partitions", "bound"), [(1, 1_000_000), (3, 1_000_000), (5, 0)])
def test_repeated_ids_with_other_texts(spark, monkeypatch, partitions, bound):
    """A link to one text of a doc_id is a link to all of it."""
    monkeypatch.setattr(minhash, "BROADCAST_IDS", bound)
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(5, a), (5, b), (2, a + " more"), (3, b + " more"), (7, c), (7, c + " x"), (9, c + " y"), (8, "alone"), (8, "words here"), (6, None), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect()}
    assert got == {(5, 2, False), (2, 2, True), (3, 2, False), (7, 7, True), (9, 7, False), (8, 8, True), (6, 6, True)}


def test_long_words_keep_apart():
    """Strings that a polynomial hash over 2^64 takes for one."""
    from symbolweave.llm.common import words

    t = "a"
    while len(t) < 2048:
        t += t.translate(str.maketrans("ab", "ba"))
    other = t.translate(str.maketrans("ab", "ba"))
    h, n = words([f"{t} {other} {t.upper()}".encode()])
    assert n.tolist() == [3] and h[0] != h[1] and h[0] == h[2]


def test_ann_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, None), (6, [0.0, 0.0]), (7, [1.0]), (8, [None, 1.0]), (20, [2.0, 1.0]), (None, [1.0, 1.0]), (40, [0.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(df, F.col("vec_id") % 20 == 0, k=3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 20, 2.0), (0, 2, 1, 1.0), (0, 3, 2, 1.0), (20, 1, 0, 2.0), (20, 2, 1, 2.0), (20, 3, 2, 2.0), (40, 1, 0, 0.0), (40, 2, 1, 0.0), (40, 3, 2, 0.0)]
    assert ann.nearest(df.limit(0), F.lit(True)).collect() == []
    twice = spark.createDataFrame([(20, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [2.0, 1.0]), (2, [1.0, 3.0])], "vec_id long, embedding array<float>").repartition(2)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(twice, F.col("vec_id") == 20).collect())
    assert got == [(20, 1, 1, 2.0), (20, 1, 2, 3.0), (20, 2, 1, 1.0), (20, 2, 2, 1.0)]


def test_ann_over_many_blocks(spark, monkeypatch):
    """Blocks of vectors by blocks of queries, each reranking a part only, merged: recall, and the best when all of a block is reranked."""
    import numpy as np

    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()}
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    monkeypatch.setattr(ann, "BLOCK", 100)
    monkeypatch.setattr(ann, "QUERIES", 7)
    ids = np.array(sorted(vectors))
    x = np.stack([vectors[i] for i in ids])
    for rerank, recall in ((30, 0.9), (100, 1.0)):
        got = {}
        for r in ann.nearest(table, F.col("vec_id") % 20 == 0, rerank=rerank, sample=1200).collect():
            got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
        hits = 0
        for q, found in got.items():
            scores = x @ vectors[q]
            best = [i for i in ids[np.lexsort((ids, -scores))] if i != q][:20]
            assert sorted(found) == list(range(1, 21))
            hits += len(set(best) & set(found.values()))
        assert len(got) == sum(ids % 20 == 0) and hits >= recall * 20 * len(got)


def test_url_filter(spark, monkeypatch):
    captures = spark.createDataFrame(
        [(1, "http://a.b.example.org/x", "2024-01-05"), (2, "HTTP://B.Example.org.:80", "2024-01-15"), (3, "http://example.org", "2024-02-15"), (4, None, "2024-01-05"), (5, "junk", "2024-01-05"), (6, "http://u@b.example.org", None), (7, "http://notexample.org", "2024-02-15")],
        "page_id long, url string, at string",
    ).select("page_id", "url", F.to_timestamp_ntz("at").alias("fetched_at"), F.lit(1).alias("blocked"))
    entries = spark.createDataFrame(
        [("b.example.org", "2024-01-01", "add"), ("b.example.org", "2024-01-10", "remove"), ("example.org", "2024-02-01", "add"), (None, "2024-01-01", "add"), ("b.example.org", None, "add"), ("b.example.org", "2024-01-01", "add")],
        "domain string, at string, action string",
    ).select("domain", F.to_timestamp_ntz("at").alias("listed_at"), "action")
    for bound in (100_000, -1):
        monkeypatch.setattr(url_filter, "BROADCAST_HOSTS", bound)
        got = {r["page_id"]: (r["blocked_"], r["blocked_by"]) for r in url_filter.filter_urls(captures, entries).collect()}
        assert got == {1: (True, "b.example.org"), 2: (False, None), 3: (True, "example.org"), 4: (False, None), 5: (False, None), 6: (False, None), 7: (False, None)}
    assert url_filter.filter_urls(captures.limit(0), entries).collect() == []
