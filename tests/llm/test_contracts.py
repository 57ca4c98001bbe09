"""Each query's result against a brute-force version or SQL, on a small table."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from symbolweave.llm import queries as q


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def rows(spark, sf_dir, name):
    return [r.asDict() for r in q.queries()[name](spark, sf_dir).collect()]


def crc(i):
    return zlib.crc32(str(i).encode())


def test_ann_recall_and_exact_scores(spark, sf_dir):
    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    got = defaultdict(list)
    for r in sorted(rows(spark, sf_dir, "op1_additive_quantisation"), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(got) == {v for v in vectors if v % 20 == 0}
    hits = 0
    for i, found in got.items():
        best = sorted(((v, float((x * vectors[i]).sum())) for v, x in vectors.items() if v != i), key=lambda p: (-p[1], p[0]))[:20]
        assert len(found) == 20 and i not in dict(found)
        for v, s in found:
            assert s == pytest.approx(float((vectors[v] * vectors[i]).sum()), abs=1e-12)
        hits += len(set(dict(best)) & set(dict(found)))
    assert hits >= 0.9 * 20 * len(got)


def test_packing_is_a_round_trip(spark, sf_dir, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, fill = defaultdict(list), defaultdict(list)
    for r in rows(spark, sf_dir, "op2_concat_and_cut"):
        pieces[r["doc_id"]].append(r)
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(docs)
    for doc, text in docs.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted(pieces[doc], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    for s, parts in fill.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 2048 or s == max(fill)


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_sql_gives_the_same_rows(spark, sf_dir, name):
    db = duckdb.connect()
    for t in ("documents", "pages"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = db.sql(q.oracle_sql()[name])
    got = q.queries()[name](spark, sf_dir)
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    key = lambda r: tuple(round(x, 9) if isinstance(x, float) else str(x) for x in r)
    assert sorted(map(key, got.select(*columns).collect()), key=str) == sorted(map(key, want.select(*columns).fetchall()), key=str)


def test_mixing_reaches_the_weights(spark, sf_dir):
    from symbolweave.llm.mixing import mix_sources

    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat('x', 9) AS text", "CASE WHEN id % 3 = 0 THEN 'a' WHEN id % 3 = 1 THEN 'b' END AS source")
    n = Counter(r["source"] for r in mix_sources(docs, {"a": 0.2, None: 0.8, "absent": 0.0}, epochs=30).collect())
    assert n["b"] == 0 and abs(n["a"] / 18000 - 1) < 0.03 and abs(n[None] / 72000 - 1) < 0.03


def test_quality_on_held_out_rows(spark, sf_dir):
    d = sf_dir.replace("sf0.001", "sf0.01")
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    got = rows(spark, d, "op5_nbsvm_quality")
    assert all(r["held_out"] == (crc(r["doc_id"]) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in label]
    right = sum(r["predicted"] == label[r["doc_id"]] for r in held)
    assert right >= 0.95 * len(held)


def dense(texts, labels):
    """Naive Bayes support vectors over a dense matrix: names of features, scaled rows' weights, slope and intercept."""
    from symbolweave.llm import quality as m

    def grams(t):
        out, code = set(), [int(c) for c in m.EXACT]
        for i in range(len(t)):
            h = 0
            for b in (t + b" " * 3)[i : i + 3]:
                h = (h * 0x9E3779B97F4A7C15 + code[b]) & 0xFFFFFFFFFFFFFFFF
            out.add(int(m.mix64(np.array([h], np.uint64))[0]) >> (64 - m.BITS))
        w = tokens(t.decode())
        again = [i > 0 and w[i] == w[i - 1] for i in range(len(w))]
        for n in range(1, m.REPEAT_GRAM + 1):
            for i in range(len(w) - n + 1):
                out.add((1 << m.BITS) - 1 - (2**n - 2) - sum(again[i + k] << k for k in range(n)))
        return out

    sets = [grams(t) for t in texts]
    names = sorted(set().union(*sets))
    x = np.array([[n in s for n in names] for s in sets], float)
    y = np.where(np.array(labels) > 0, 1.0, -1.0)
    counts = [x[y == k].sum(0) + 1 for k in (1, -1)]
    rest = (1 << m.BITS) - len(names)
    return names, sets, x * (np.log(counts[0] / (counts[0].sum() + rest)) - np.log(counts[1] / (counts[1].sum() + rest))), y


def test_quality_equals_a_dense_model(spark, sf_dir, docs):
    from symbolweave.llm import quality as m

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    some = {r["doc_id"]: r["quality"] for r in labels.collect() if crc(r["doc_id"]) % 5 and r["doc_id"] in docs and len(docs[r["doc_id"]] or "") < 3000}
    ids = sorted(some)
    texts = [(docs[i] or "").encode() for i in ids]
    names, sets, z, y = dense(texts, [some[i] for i in ids])
    flat, starts = m.features(texts)
    rows = [flat[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
    assert [set(r.tolist()) for r in rows] == sets
    ratio = m.log_count_ratios(rows, y)
    assert np.allclose(z, [[ratio[n] * (n in s) for n in names] for s in sets])
    # the dual solution is the primal's minimum, found here by Newton steps on the squared hinge
    w, bias = m.dual_coordinate_descent(rows, y, ratio, epochs=400)
    a = np.hstack([z, np.ones((len(z), 1))])
    loss = lambda v: 0.5 * v @ v + 0.1 * (np.maximum(1 - y * (a @ v), 0) ** 2).sum()
    v = np.zeros(a.shape[1])
    for _ in range(60):
        live = y * (a @ v) < 1
        g = v - 0.2 * a[live].T @ (y[live] * (1 - y[live] * (a[live] @ v)))
        # (I + 0.2 A'A)^-1 g, by the rows that are live
        k = np.linalg.solve(np.eye(live.sum()) / 0.2 + a[live] @ a[live].T, a[live] @ g)
        step, d = 1.0, g - a[live].T @ k
        while loss(v - step * d) > loss(v) and step > 1e-9:
            step /= 2
        v = v - step * d
    mine = np.append([w[n] for n in names], bias)
    assert loss(mine) == pytest.approx(loss(v), rel=1e-3) and np.allclose(a @ mine, a @ v, atol=0.02)
    # the query's scores are those of its weights, feature by feature
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    weight, slope, shift = m.fit(table, labels)
    got = {r["doc_id"]: r["score"] for r in m.classify(table, labels).collect()}
    for i, s in zip(ids, sets, strict=True):
        assert got[i] == pytest.approx(1 / (1 + np.exp(-np.clip(slope * sum(weight[n] for n in s) + shift, -500, 500))), abs=1e-9)


def brute_spans(docs, length=100):
    seen, out = set(), {}
    for doc in sorted(docs):
        t = (docs[doc] or "").encode()
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            w = t[i : i + length]
            if w in seen:
                gone[i : i + length] = True
            seen.add(w)
        edge = np.diff(gone.astype(int), prepend=0)
        out[doc] = (len(t), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=False) if not g)).hexdigest())
    return out


def test_suffix_dedup_is_exact(spark, sf_dir, docs):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows(spark, sf_dir, "op6_suffix_array_dedup")}
    assert got == brute_spans(docs)


def test_suffix_dedup_of_hot_grams(docs):
    """Every repeated gram by its windows' hashes gives the same bytes as sorted bins."""
    import pyarrow as pa

    from symbolweave.llm import suffix_dedup as s

    texts = [(docs[d] or "").encode() for d in sorted(docs) if d < 60]
    doc, pos, left, right, h, _ = s.anchors(texts)
    rows = [
        {"hash": int(x), "doc_id": int(d), "block": 0, "row": int(d), "spot": s._spot(int(p), int(a), int(b)), "copies": None, "turn": 1, "contexts": s.HOT + 1}
        for d, p, a, b, x in zip(doc, pos, left, right, h.view(np.int64), strict=True)
    ]
    text = pa.table({"block": [0] * len(texts), "row": list(range(len(texts))), "doc_id": list(range(len(texts))), "text": texts})
    out = [r for r in s._records(text, pa.Table.from_pylist(rows)).to_pylist() if r["kind"] == 1]
    spans = pa.table({"row": [r["row"] for r in out], "start": [r["pos"] for r in out], "stop": [r["pos"] + 100 for r in out]})
    got = [tuple(r[c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in s._cut(text, spans).to_pylist()]
    assert got == list(brute_spans({i: t.decode() for i, t in enumerate(texts)}).values())


def test_suffix_dedup_small_blocks(spark, docs):
    from symbolweave.llm.suffix_dedup import repeated_spans

    some = {k: v for k, v in docs.items() if k < 80}
    some[1000] = "Of " * 900
    some[1001] = "x" + "Of " * 500 + "%%% " * 200 + "Of " * 60
    some[1002] = "ab" * 20 + "".join(map(str, range(400)))
    some[1003] = "".join(map(str, range(100, 400))) + "ab" * 70
    df = spark.createDataFrame(list(some.items()), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeated_spans(df, block_bytes=20_000).collect()}
    assert got == brute_spans(some)


TOKEN = re.compile(rb"[^\x20\x09-\x0D]+")


def tokens(text):
    return TOKEN.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))


class Automaton:
    """The automaton by dictionaries: states with arcs and failure arcs, traversed token by token."""

    def __init__(self, train):
        from symbolweave.llm.language_model import MIN_WEIGHT

        self.c = [Counter(tuple(s[i : i + k]) for s in train for i in range(len(s) - k + 1)) for k in (1, 2, 3)]
        self.n, self.v = sum(self.c[0].values()), len(self.c[0])
        n1, n2 = (sum(x == k for x in self.c[0].values()) for k in (1, 2))
        self.d = n1 / (n1 + 2 * n2) if n1 else 0.5
        events, single = Counter(), Counter()
        for k in (1, 2):
            for g, x in self.c[k].items():
                kind = k, self.c[k - 1][g[:-1]].bit_length() - 1
                events[kind] += x
                single[kind] += x == 1
        self.weight = {kind: max(1 - (single[kind] + 1) / (e + 2), MIN_WEIGHT) for kind, e in events.items()}
        self.arcs, self.failure = defaultdict(dict), {}
        for k in (1, 2):
            for g, x in self.c[k].items():
                self.arcs[g[:-1]][g[-1]] = x
        for h in self.arcs:
            self.failure[h] = 1 - self.a(h)

    def a(self, h):
        return self.weight[len(h), self.c[len(h) - 1][h].bit_length() - 1]

    def arc(self, h, w):
        if not h:
            c = self.c[0][(w,)]
            return max(c - self.d, 0) / self.n + self.d * self.v / self.n / (self.v + 1)
        below = h[1:]
        lower = self.arc(below, w) if not below or w in self.arcs[below] else self.failure[below] * self.arc((), w)
        return self.a(h) * self.arcs[h][w] / self.c[len(h) - 1][h] + (1 - self.a(h)) * lower

    def score(self, stream):
        state, out = (), 0.0
        for w in stream:
            at = state
            while at and w not in self.arcs[at]:
                out += np.log10(self.failure[at])
                at = at[1:]
            out += np.log10(self.arc(at, w))
            state = (*state, w)
            while state and (len(state) > 2 or state not in self.failure):
                state = state[1:]
        return out


def test_language_model(spark, sf_dir, docs):
    end = ("end",)
    streams = {d: [*tokens(t), end] for d, t in docs.items()}
    model = Automaton([s for d, s in streams.items() if crc(d) % 10])
    c, n, v = model.c[0], model.n, model.v
    got = {r["doc_id"]: r for r in rows(spark, sf_dir, "op7_backoff_lm")}
    assert set(got) == set(docs)
    for d, s in streams.items():
        r = got[d]
        base = sum(np.log10((c[(w,)] + 0.1) / (n + 0.1 * (v + 1))) for w in s)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(s), sum(c[(w,)] > 0 for w in s), n, crc(d) % 10 == 0)
        assert r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(model.score(s))
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert sum(r["score"] > r["base_score"] for r in got.values()) > 0.9 * len(docs)


def test_language_model_is_a_distribution(docs):
    """After any state, the probabilities of all words, the end and the unknown word sum to 1."""
    model = Automaton([[*tokens(t), ("end",)] for d, t in docs.items() if d < 40])
    states = [(), *list(model.failure)[:: max(1, len(model.failure) // 8)]]
    for h in states:
        total = 0.0
        for w in [g[0] for g in model.c[0]] + ["never seen"]:
            at, p = h, 1.0
            while at and w not in model.arcs[at]:
                p *= model.failure[at]
                at = at[1:]
            total += p * model.arc(at, w)
        assert total == pytest.approx(1)


def test_language_model_is_one_over_blocks_and_ranges(spark, sf_dir, monkeypatch):
    from symbolweave.llm import language_model

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    whole = {r["doc_id"]: r.asDict() for r in language_model.lm_scores(docs).collect()}
    monkeypatch.setattr(language_model, "RANGE_KEYS", 3000)
    cut = {r["doc_id"]: r.asDict() for r in language_model.lm_scores(docs, block_bytes=50_000).collect()}
    assert cut.keys() == whole.keys()
    for d, r in cut.items():
        assert r == pytest.approx(whole[d])


def test_language_model_of_rare_ngrams(spark):
    """Words, pairs and triples seen once or twice count, and a text that occurs twice is likelier than one that occurs once."""
    from symbolweave.llm import language_model

    ids = [i for i in range(1, 200) if crc(i) % 10]
    texts = {ids[0]: "rare pair here", ids[1]: "rare pair here", ids[2]: "once only there", ids[3]: None}
    texts |= {i: " ".join(f"w{(i * j) % 7}" for j in range(1, 9)) for i in ids[4:40]}
    got = {r["doc_id"]: r["score"] for r in language_model.lm_scores(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    streams = {i: [*tokens(t), ("end",)] for i, t in texts.items()}
    model = Automaton(list(streams.values()))
    for i, s in streams.items():
        assert got[i] == pytest.approx(model.score(s))
    assert got[ids[0]] > got[ids[2]]


def test_language_model_without_training_documents(spark):
    from symbolweave.llm import language_model

    held = [i for i in range(100) if crc(i) % 10 == 0][:3]
    got = language_model.lm_scores(spark.createDataFrame([(i, "some words") for i in held], "doc_id long, text string")).collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got] == [(3, 0, 0, 0.0, 0.0)] * 3


def test_shards(spark, sf_dir, docs):
    got = rows(spark, sf_dir, "op8_byte_balanced_shards")
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    size, slots = Counter(), defaultdict(list)
    for r in got:
        t = (docs[r["doc_id"]] or "").encode()
        assert r["size"] == len(t) + 1 and r["text_crc32"] == zlib.crc32(t) and r["law"] == "bytes" and r["grown_shard"] is None
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(size) == set(range(8)) and max(size.values()) - min(size.values()) <= 2 * max(r["size"] for r in got)


def brute_components(docs, k, percent):
    sets = {}
    for d, t in docs.items():
        w = tokens(t)
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    owners = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            owners[x].append(d)
    common = Counter()
    for o in owners.values():
        for i, a in enumerate(o):
            for b in o[i + 1 :]:
                common[a, b] += 1
    parent = {d: d for d in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), find(d)) for d in docs}


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, sf_dir, k, percent):
    from symbolweave.llm.minhash import near_duplicates

    table = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    docs = {r["doc_id"]: r["text"] for r in table.collect()}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(table, k, percent).collect()}
    assert got == brute_components(docs, k, percent)
