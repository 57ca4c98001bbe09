"""Quality classifier: naive Bayes support vectors.

Features are indicators of hashed byte n-grams of the whole text, and of the n-grams, up to REPEAT_GRAM long, of the
stream "this word repeats the one before". Each is scaled by the log ratio of its smoothed class counts, and a linear hinge-loss model is fitted on
the scaled indicators by dual coordinate descent, interpolated with the mean weight, and mapped to 0..1 by a logistic
fit on its training margins.

The fit sees at most max_rows labelled rows (those whose ids hash smallest); scoring reads every text. Labels, lang,
source and doc_id are no inputs of a score. Edge cases: null and empty texts have no features and get the model's
constant; a doc_id labelled twice takes its smaller label; null labels don't count; with labels of one class or none,
every score is the labels' mean, or 1 without labels. Repeated rows are scored one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symbolweave.llm.common import EXACT, fresh, held_out, mix64, quoted, runs, tidy, words

BITS, GRAM, REPEAT_GRAM = 18, 3, 6
#: The bound of the labelled sample that the model is fitted on.
MAX_ROWS, THRESHOLD, HELD_OUT = 6000, 0.3, 5


def features(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature ids of each text, one text after another, and where each text's begin (with the end last)."""
    gap = b" " * (GRAM - 1)  # so that no gram reaches the next text
    buf = np.frombuffer(gap.join(texts) + gap, np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    first = np.concatenate(([0], np.cumsum(sizes + len(gap))[:-1]))
    code = EXACT[buf]
    h = np.zeros(max(len(buf) - GRAM + 1, 0), np.uint64)
    for i in range(GRAM):
        h = h * np.uint64(0x9E3779B97F4A7C15) + code[i : i + len(h)]
    h = mix64(h) >> np.uint64(64 - BITS)
    # grams that start in a text, with the spaces after it, are its own
    doc = np.repeat(np.arange(len(texts)), sizes)
    at = np.arange(int(sizes.sum())) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)
    keys = (doc.astype(np.uint64) << np.uint64(BITS)) | h[at]
    w, n = words(texts)
    owner = np.repeat(np.arange(len(texts)), n)
    again = np.zeros(len(w), bool)
    again[1:] = (w[1:] == w[:-1]) & (owner[1:] == owner[:-1])
    own = [keys]
    for n in range(1, REPEAT_GRAM + 1):
        m = max(len(again) - n + 1, 0)
        bits = sum((again[k : k + m].astype(np.uint64) << np.uint64(k) for k in range(n)), np.zeros(m, np.uint64))
        whole = owner[:m] == owner[n - 1 : n - 1 + m]
        # patterns of n bits have the ids before those of fewer, from the last id down
        ids = np.uint64((1 << BITS) - 1 - (2**n - 2)) - bits
        own.append(np.unique((owner[:m].astype(np.uint64) << np.uint64(BITS) | ids)[whole]))
    keys = np.unique(np.concatenate(own))
    starts = np.searchsorted(keys, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(BITS))
    return (keys & np.uint64((1 << BITS) - 1)).astype(np.int32), starts


def _extract(batches):
    for b in batches:
        ids, labels = b.column("doc_id"), b.column("label")
        for lo, texts in runs(b.column("text")):
            f, s = features(texts)
            rows = [f[s[i] : s[i + 1]].astype("<i4").tobytes() for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([ids.slice(lo, len(texts)), labels.slice(lo, len(texts)), pa.array(rows, pa.binary())], ["doc_id", "label", "features"])


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    counts = [np.full(1 << BITS, alpha), np.full(1 << BITS, alpha)]
    for x, label in zip(rows, y, strict=True):
        counts[int(label > 0)][x] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, c: float = 0.1, epochs: int = 12, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights (of scaled indicators) and bias of the squared-hinge linear model; y is -1 or 1."""
    w, bias, alpha = np.zeros(len(scale)), 0.0, np.zeros(len(rows))
    values = [scale[x] for x in rows]
    norm = np.array([v @ v + 1.0 for v in values]) + 0.5 / c
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            x, v = rows[i], values[i]
            g = y[i] * (w[x] @ v + bias) - 1 + alpha[i] * 0.5 / c
            step = max(alpha[i] - g / norm[i], 0.0) - alpha[i]
            if step:
                alpha[i] += step
                w[x] += step * y[i] * v
                bias += step * y[i]
                worst = max(worst, abs(step) * norm[i])
        if worst < 1e-3:
            break
    return w, bias


def logistic_fit(margin: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """a, b of 1/(1+exp(-(a*margin+b))), by Newton steps with Platt's smoothed targets."""
    hi, lo = ((y > 0).sum() + 1) / ((y > 0).sum() + 2), 1 / ((y <= 0).sum() + 2)
    target, a, b = np.where(y > 0, hi, lo), 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g, v = p - target, p * (1 - p) + 1e-9
        h = np.array([[v @ margin**2 + 1e-6, v @ margin], [v @ margin, v.sum() + 1e-6]])
        d = np.linalg.solve(h, np.array([g @ margin, g.sum()]))
        a, b = a - d[0], b - d[1]
        if np.abs(d).max() < 1e-8:
            break
    return max(a, 1e-3), b


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, beta: float = 0.25) -> tuple[np.ndarray, float, float]:
    """(weight of each feature, slope, intercept) from labelled rows that are not held out."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("label"))
    known = known.where(~held_out(F.col("doc_id"), HELD_OUT)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    sample = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")).join(F.broadcast(known), "doc_id")
    got = sample.select("doc_id", F.col("label").cast("int").alias("label"), "text").mapInArrow(_extract, "doc_id long, label int, features binary")
    got = got.orderBy("doc_id", F.xxhash64("features")).limit(2 * max_rows).toArrow()
    y = np.where(np.array(got.column("label").to_pylist(), float) > 0, 1.0, -1.0)
    if len(y) == 0 or abs(y.sum()) == len(y):
        p = min(max((y > 0).mean() if len(y) else 1.0, 1e-6), 1 - 1e-6)
        return np.zeros(1 << BITS), 0.0, float(np.log(p / (1 - p)))
    rows = [np.frombuffer(x, "<i4") for x in got.column("features").to_pylist()]
    ratio = log_count_ratios(rows, y)
    w, bias = dual_coordinate_descent(rows, y, ratio)
    # interpolation: weights of features are drawn toward their mean size, so that rare strong ones weigh less alone
    used = w != 0
    w[used] = (1 - beta) * w[used] + beta * np.abs(w[used]).mean() * np.sign(w[used])
    weight = w * ratio
    margin = np.array([weight[x].sum() for x in rows]) + bias
    a, b = logistic_fit(margin, y)
    return weight, a, b + a * bias


def _score(columns: list[str], weight: np.ndarray, a: float, b: float):
    def run(batches):
        for batch in batches:
            scores = np.empty(batch.num_rows)
            for lo, texts in runs(batch.column(0)):
                f, s = features(texts)
                sums = np.concatenate(([0.0], np.cumsum(weight[f])))
                scores[lo : lo + len(texts)] = 1 / (1 + np.exp(-np.clip(a * (sums[s[1:]] - sums[s[:-1]]) + b, -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(scores)], columns)

    return run


def score(docs: DataFrame, model: tuple[np.ndarray, float, float], name: str = "score") -> DataFrame:
    """docs with the column name: how likely label 1 is, from its text alone."""
    weight, a, b = model
    # by place: a Python stage can't look up names with a dot
    fed = docs.select(F.coalesce(F.col("text"), F.lit("")).cast("binary"), *quoted(docs.columns)).toDF(*[f"c{i}" for i in range(len(docs.columns) + 1)])
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    return fed.mapInArrow(tidy(_score([*docs.columns, name], weight.astype(np.float64), a, b)), schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that the classifier rejects."""
    name = fresh(docs, "score")
    return score(docs, fit(docs, labels), name).where(F.col(name) >= threshold).drop(name)
