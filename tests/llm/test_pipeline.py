"""The pipeline on the small tables, and a tiny corpus followed through its stages by plain Python."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as c
from tests.llm.test_contracts import brute_components


def test_stages_on_all_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = [docs.count()]
    for _, stage in c.STAGES[:3]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.toArrow())
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * sizes[0]
    mixed = c.STAGES[3][1](spark, docs, sf_dir)
    assert mixed.columns == docs.columns
    assert {r["doc_id"] for r in mixed.collect()} <= {r["doc_id"] for r in docs.collect()}


def copies(doc_id, rate):
    """Poisson inversion as the mixing stage defines it, for one draw."""
    u = int(hashlib.md5(f"mix-1|{doc_id}|1".encode()).hexdigest()[:13], 16) / (1 << 52)
    p = total = math.exp(-rate)
    n = 0
    while total <= u:
        n += 1
        p *= rate / n
        total += p
    return n


NOUNS = "river stone winter letter garden window market teacher mountain harbour violin candle forest engine bridge island".split()


def sentence(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(f"the {rng.choice(NOUNS)} near the {rng.choice(NOUNS)} was {rng.choice(['old', 'quiet', 'green', 'cold'])} in {rng.integers(1200, 1999)}" for _ in range(n)) + "."


def tiny():
    clean = {i: sentence(i, 12) for i in range(1, 41)}
    clean |= {101: clean[1], 102: clean[1], 103: clean[2] + " indeed", 104: clean[3].replace("the ", "the very ", 1), 105: clean[105 - 100] + " " + sentence(900, 1)}
    junk = {i: " ".join(["$$%#@"] * (40 + i % 7) + [f"xx{i}!!"] * 9) for i in range(200, 240)}
    rows = [(i, t, "en", "web" if i % 3 else "books") for i, t in clean.items()] + [(i, t, "en", "web") for i, t in junk.items()]
    labels = [(i, 1, 0) for i in range(1, 41)] + [(i, 0, 0) for i in junk]
    return clean, rows, labels


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, Copies int, `key` string, Score double"


def saved(spark, tmp_path, rows, labels):
    full = [(i, t, lang, src, len(t or ""), 7, "k", 0.5) for i, t, lang, src in rows]
    spark.createDataFrame(full, COLUMNS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_a_tiny_corpus_through_all_stages(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    clean, rows, labels = tiny()
    d = saved(spark, tmp_path, rows, labels)
    docs, kept = spark.read.parquet(f"{d}/documents.parquet"), []
    for _, stage in c.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, d).toArrow())
        assert [n for n, _ in docs.dtypes] == [x.strip(" `").split("`")[0].split(" ")[0] for x in COLUMNS.split(", ")]
        kept.append(Counter(r["doc_id"] for r in docs.collect()))
    assert set(kept[0]) == set(clean)
    last = {}
    for i, t in clean.items():
        last[t] = max(i, last.get(t, i))
    exact = {i: clean[i] for i in last.values()}
    assert set(kept[1]) == set(exact)
    near = {i: t for i, t in exact.items() if brute_components(exact, 5, 80)[i][1] == i}
    assert set(kept[2]) == set(near) and len(near) < len(exact)
    source = lambda i: "web" if i % 3 else "books"
    size = Counter()
    for i, t in near.items():
        size[source(i)] += len(t.encode()) + 1
    want = Counter({i: n for i in near if (n := copies(i, sum(size.values()) / (len(size) * size[source(i)])))})
    assert kept[3] == want
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = sorted((r["sequence_id"], r["offset"], r["ids"]) for r in c.run(spark, d).collect())
    stream = np.frombuffer(b"".join(p[2] for p in pieces), "<u4").tolist()
    assert [p[0] * 2048 + p[1] for p in pieces] == np.cumsum([0, *(len(p[2]) // 4 for p in pieces)])[:-1].tolist()
    found, doc = Counter(), []
    for t in stream:
        if t == 1:
            found[tuple(doc)] += 1
            doc = []
        else:
            doc.append(t)
    assert not doc and found == Counter({tuple(tokenizer.encode(near[i], add_special_tokens=False).ids): n for i, n in want.items()})


@pytest.mark.parametrize("case", ["empty", "nulls", "no labels"])
def test_run_on_odd_tables(spark, tmp_path, case):
    """Empty tables, nulls in every column, no label at all: what is defined is that all good rows go through."""
    _, rows, labels = tiny()
    if case == "empty":
        d = saved(spark, tmp_path, [], labels)
        assert c.run(spark, d).collect() == []
        return
    odd = [(None, None, None, None), (None, sentence(77, 5), None, None), (500, "", None, None), (501, None, None, "web"), (502, sentence(78, 4000), None, None)]
    d = saved(spark, tmp_path, rows[:45] + odd if case == "nulls" else odd, labels + [(None, None, None), (500, None, 1)] if case == "nulls" else [])
    got = c.run(spark, d).collect()
    assert {r["doc_id"] for r in got} <= {None, *range(1, 106), 500, 501, 502} and len(got) > 0


def test_run(spark, sf_dir):
    got = c.run(spark, sf_dir)
    assert got.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    total = got.selectExpr("sum(length) AS n", "max(sequence_id) + 1 AS s").first()
    assert 0 <= total["s"] * 2048 - total["n"] < 2048
