"""LM scoring with a weighted backoff automaton.

An interpolated model of order ORDER is counted on all training documents. Its automaton has a root and a state for each
training n-gram of up to ORDER - 1 words that another token follows. A state has an arc for each token that follows it
in training, and a failure arc to the state without its first word, down to the root, which has an arc for every word
and one for unknown words. With c the training counts and a the weight of a state h (below), an arc weighs
log10(a(h) c(hw) / c(h) + (1 - a(h)) p(w | shorter h)) and a failure arc log10(1 - a(h)). Nothing counted is left out: there
are no cut-offs. The weight of states is fitted by leaving one out: for each order and each power of two of c(h), 1 - a
is the share of training events after such states that no other event repeats (c(hw) = 1), smoothed by one event of
either kind; a is at least MIN_WEIGHT, so that every arc has its say.

A text is traversed once from left to right, with the state carried from token to token: at each token the automaton
follows failure arcs until a state has the token's arc, and takes it. Every part of a training n-gram is one too, so the
state after a token is the longest end of the one before and the token that is a state: one word longer at most.

Documents are tokenised once, into blocks of about BLOCK_BYTES with a dictionary each, written bucketed by block. A
block's distinct n-grams of all orders are sorted by key and sent as packed cells, one for each order and key range that
has any (a range holds about RANGE_KEYS of them, so their number grows with the corpus); a range sums the counts and
answers each cell. So each block gets back the part of the automaton that its own words need, and no model is ever held
whole, whatever the vocabulary. A hot word is one entry a block.

Words go by 64-bit hashes, longer n-grams by the first key_bits() of theirs: KEY_MARGIN bits more than the corpus has
entries need to be told apart, so that of 2^KEY_MARGIN (16 million) n-grams about one shares its key with another.

Edge cases: null and empty texts are the end token alone; repeated rows are scored one by one and counted one by one;
a null doc_id counts as the empty text for the split; without training documents every token is unknown
(probability 1 for the model and by the base formula). An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symbolweave.llm.common import bucket_count, bucketed, held_out, mix64, partition_id, runs, words

HELD_OUT, ORDER, MIN_WEIGHT = 10, 3, 0.05
#: Text bytes of a block: half of what other operators hold, as a block's tokens take several arrays of eight bytes each.
BLOCK_BYTES = 8 << 20
#: Entries (an n-gram of a block) that a key range holds, about; the number of ranges grows with the corpus.
RANGE_KEYS = 1 << 20
#: Bits of an n-gram's key beyond those that number the corpus's entries, and the fewest that a key has.
KEY_MARGIN, KEY_BITS = 24, 48
END = 1  # the key of the end token
BLOCK = "block long, doc_id long, held_out boolean, tokens int, ids binary, counts binary"
CELL = "range long, block long, order int, keys binary, n binary"
ANSWER = "block long, order int, range long, n binary, total long, types long, once long, twice long"


def _schema(text: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in text.split(", "))])


def _blocks(block_bytes: int):
    """Documents as indexes into their block's dictionary, then the dictionary with its training counts."""
    schema = _schema(BLOCK)

    def flush(number, docs, hashes, sizes):
        keys, index = np.unique(np.concatenate(hashes), return_inverse=True)
        index = index.astype("<u4")
        held = np.array([d[1] for d in docs])
        # frequent words get small indexes, whose high bytes vanish when compressed
        order = np.argsort(-np.bincount(index), kind="stable")
        keys, index = keys[order], np.argsort(order).astype("<u4")[index]
        counts = np.bincount(index[np.repeat(~held, sizes)], minlength=len(keys)).astype("<u4")
        stops = np.cumsum(sizes)
        block = (partition_id() << 24) + number
        for lo in range(0, len(docs), 2048):
            hi = min(lo + 2048, len(docs))
            ids = [_planes(index[stops[i] - sizes[i] : stops[i]]) for i in range(lo, hi)]
            yield batch([block] * (hi - lo), [d[0] for d in docs[lo:hi]], held[lo:hi].tolist(), sizes[lo:hi], ids, [None] * (hi - lo))
        yield batch([block], [None], [None], [0], [keys.astype("<u8").tobytes()], [counts.tobytes()])

    def batch(*columns):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def run(batches):
        number, docs, hashes, sizes, size = 0, [], [], [], 0
        for b in batches:
            ids, held = b.column("doc_id").to_pylist(), b.column("held_out").to_pylist()
            for lo, texts in runs(b.column("text")):
                h, n = words(texts)
                h[h == END] += np.uint64(1)
                hashes.append(np.insert(h, np.cumsum(n), np.uint64(END)))
                sizes.extend((n + 1).tolist())
                docs.extend(zip(ids[lo : lo + len(texts)], held[lo : lo + len(texts)], strict=True))
                size += sum(map(len, texts)) + len(texts)
                if size >= block_bytes:
                    yield from flush(number, docs, hashes, sizes)
                    number, docs, hashes, sizes, size = number + 1, [], [], [], 0
        if docs:
            yield from flush(number, docs, hashes, sizes)

    return run


def key_bits(entries: int) -> int:
    return min(64, max(KEY_BITS, entries.bit_length() + KEY_MARGIN))


def _planes(values: np.ndarray) -> bytes:
    """Numbers by byte planes, all lowest bytes first: planes of zeros vanish when compressed."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def _unplaned(planes: bytes, dtype: str) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, -1).T).view(dtype).ravel()


def _pack(values: np.ndarray) -> bytes:
    """64-bit values, compressed after their number."""
    return len(values).to_bytes(4, "little") + pa.compress(_planes(values.astype("<u8")), "zstd", asbytes=True)


def _unpack(packed: bytes) -> np.ndarray:
    return _unplaned(pa.decompress(packed[4:], 8 * int.from_bytes(packed[:4], "little"), "zstd", asbytes=True), "<u8")


class Block:
    """A block's documents as one stream of tokens, and its n-grams by order.

    first: where documents begin in the stream, with the end last. keys[k], at[k], where[k] for order k + 1: the sorted
    distinct keys, the positions in the stream that an n-gram ends at, and the index into keys of each. Beyond words,
    only the first bits of a key are not 0.
    """

    def __init__(self, block: pa.Table, bits: int):
        is_doc = pc.is_null(block.column("counts"))
        self.docs, dictionary = block.filter(is_doc), block.filter(pc.invert(is_doc))
        ids = [_unplaned(x, "<u4") for x in self.docs.column("ids").to_pylist()]
        self.number = block.column("block")[0].as_py()
        self.first = np.cumsum([0, *map(len, ids)])
        stream = np.concatenate(ids)
        self.train = np.repeat(~np.array(self.docs.column("held_out")), np.diff(self.first))
        words_ = np.frombuffer(dictionary.column("ids")[0].as_py(), "<u8")
        order = np.argsort(words_)
        self.words = np.frombuffer(dictionary.column("counts")[0].as_py(), "<u4")[order]
        self.keys, self.at, self.where = [words_[order]], [np.arange(self.first[-1])], [np.argsort(order)[stream]]
        self.past = np.arange(self.first[-1]) - np.repeat(self.first[:-1], np.diff(self.first))
        last = words_[stream]
        gram, low = last, np.uint64(64 - bits)
        for order in range(2, ORDER + 1):
            # the n-gram ending here: the one a word shorter that ends a token earlier, and this token
            grown = np.zeros(len(gram), np.uint64)
            grown[1:] = mix64(gram[:-1] * np.uint64(0x9E3779B97F4A7C15) + last[1:])
            gram = grown
            at = np.flatnonzero(self.past >= order - 1)
            keys, where = np.unique(gram[at] >> low << low, return_inverse=True)
            self.keys.append(keys)
            self.at.append(at)
            self.where.append(where)

    def training_counts(self, order: int) -> np.ndarray:
        """How often each n-gram is in the block's training documents."""
        k = order - 1
        return self.words if not k else np.bincount(self.where[k][self.train[self.at[k]]], minlength=len(self.keys[k]))

    def spread(self, counts: list[np.ndarray]) -> list[np.ndarray]:
        """By order, for each token the corpus count of the n-gram that ends there; 0 where the document has none."""
        out = []
        for at, where, c in zip(self.at, self.where, counts, strict=True):
            full = np.zeros(len(self.past), np.int64)
            full[at] = c[where]
            out.append(full)
        return out


def _cells(keys: np.ndarray, ranges: int):
    """Of sorted keys: the ranges that they fall into, and where each range's begin (with the end last)."""
    number = (keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
    found, starts = np.unique(number, return_index=True)
    return found.astype(np.int64), np.append(starts, len(keys))


def _send(ranges: int, bits: int):
    """A block's distinct n-grams by order and key range, with how often each is in its training documents."""
    schema = _schema(CELL)

    def run(table: pa.Table) -> pa.Table:
        b, rows = Block(table, bits), []
        for order in range(1, ORDER + 1):
            keys, n = b.keys[order - 1], b.training_counts(order)
            low = np.uint64(64 - bits if order > 1 else 0)
            found, starts = _cells(keys, ranges)
            for r, lo, hi in zip(found.tolist(), starts[:-1], starts[1:], strict=True):
                gaps = np.diff(keys[lo:hi] >> low, prepend=np.uint64(0))
                rows.append((r, b.number, order, _pack(gaps), _pack(n[lo:hi])))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def _answer(part: pa.Table) -> pa.Table:
    """For each cell of a key range the corpus counts of its n-grams; the range's first cell also tells the sums of its words."""
    schema, out = _schema(ANSWER), []
    for order in range(1, ORDER + 1):
        cells = part.filter(pc.equal(part.column("order"), order))
        if not cells.num_rows:
            continue
        keys = [_unpack(x).cumsum(dtype=np.uint64) for x in cells.column("keys").to_pylist()]
        n = np.concatenate([_unpack(x) for x in cells.column("n").to_pylist()]).astype(np.int64)
        distinct, where = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, where, n)
        told = [int(x.sum()) for x in (total, total > 0, total == 1, total == 2)] if order == 1 else [None] * 4
        stops = np.cumsum([0, *map(len, keys)])
        number = cells.column("range")[0].as_py()
        for block, lo, hi in zip(cells.column("block").to_pylist(), stops[:-1], stops[1:], strict=True):
            out.append((block, order, number, _pack(total[where[lo:hi]]), *told))
            told = [None] * 4
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def _counts(answers: pa.Table) -> list[np.ndarray]:
    """By order, the corpus counts of a block's n-grams in the order of their keys: ranges ascend as keys do."""
    answers = answers.sort_by([("order", "ascending"), ("range", "ascending")])
    by_order = [[] for _ in range(ORDER)]
    for order, n in zip(answers.column("order").to_pylist(), answers.column("n").to_pylist(), strict=True):
        by_order[order - 1].append(_unpack(n).astype(np.int64))
    return [np.concatenate(x) if x else np.zeros(0, np.int64) for x in by_order]


def bucket(count: np.ndarray) -> np.ndarray:
    """The power of two that a positive count reaches."""
    return np.frexp(count.astype(float))[1] - 1


def _novelty(bits: int):
    """By order and bucket of the state's count: the block's training events after such states, and those that occur once in the corpus."""
    schema = _schema("order int, bucket int, events long, single long")

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return schema.empty_table()
        b, rows = Block(table, bits), []
        c = b.spread(_counts(answers))
        for order in range(2, ORDER + 1):
            at = b.at[order - 1][b.train[b.at[order - 1]]]
            kind = bucket(c[order - 2][at - 1])
            events = np.bincount(kind)
            single = np.bincount(kind, weights=c[order - 1][at] == 1, minlength=len(events)).astype(np.int64)
            rows += [(order, i, int(e), int(s)) for i, (e, s) in enumerate(zip(events, single, strict=True)) if e]
        if not rows:
            return schema.empty_table()
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def state_weights(rows) -> np.ndarray:
    """[order - 2, bucket]: what a state's own arcs weigh against the shorter state's. rows: (order, bucket, events, single)."""
    out = np.full((ORDER - 1, 64), MIN_WEIGHT)
    for order, kind, events, single in rows:
        out[order - 2, kind] = max(1 - (single + 1) / (events + 2), MIN_WEIGHT)
    return out


def word_probability(c, total: int, types: int, discount: float):
    """The root's arcs: absolute discounting, interpolated with the uniform distribution over all words and the unknown one."""
    if not total:
        return np.ones(np.shape(c))
    return np.maximum(np.asarray(c, float) - discount, 0) / total + discount * types / total / (types + 1)


def traverse(c: list[np.ndarray], past: np.ndarray, root: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """log10 of each token's probability, in one pass over all documents of a block.

    c: by order, the corpus count of the n-gram that ends at each token. past: tokens of the document before each. root:
    the root's arcs. The carried state is one word longer than before where that is a state, else as long as the
    longest end that is one.
    """
    state = np.zeros(len(past), np.int64)  # words of the state that each token is read in
    for k in range(1, ORDER):
        longer = np.zeros(len(past), bool)
        longer[1:] = (past[1:] >= k) & (c[k - 1][:-1] > 0)
        state[longer & (state == k - 1)] = k
    p = root.copy()  # up the failure arcs: from the root's arc to that of the state carried
    for k in range(1, ORDER):
        at = np.flatnonzero(state >= k)
        held = c[k - 1][at - 1]
        a = weight[k - 1, bucket(held)]
        p[at] = a * c[k][at] / held + (1 - a) * p[at]
    return np.log10(p)


def _score(bits: int, total: int, types: int, discount: float, weight: np.ndarray):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        schema = _schema("doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
        if not table.num_rows:
            return schema.empty_table()
        b = Block(table, bits)
        c = b.spread(_counts(answers))
        logs = traverse(c, b.past, word_probability(c[0], total, types, discount), weight)
        base = np.log10((c[0] + 0.1) / (total + 0.1 * (types + 1)))
        sums = [np.add.reduceat(x, b.first[:-1]) for x in ((c[0] > 0).astype(np.int64), base, logs)]
        cols = [b.docs.column("doc_id"), b.docs.column("held_out"), pa.array(np.diff(b.first)), *map(pa.array, sums)]
        return pa.Table.from_arrays(cols, schema=schema)

    return run


def lm_scores(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs (doc_id, text)."""
    fed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), HELD_OUT).alias("held_out"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    buckets = bucket_count(fed)
    blocks = bucketed(fed.mapInArrow(_blocks(block_bytes), BLOCK), "block", "lm", buckets)
    by_block = blocks.groupBy("block")
    tokens = blocks.agg(F.sum("tokens").alias("n")).first()["n"] or 0
    ranges, bits = max(1, -(-ORDER * tokens // RANGE_KEYS)), key_bits(ORDER * tokens)
    cells = by_block.applyInArrow(_send(ranges, bits), CELL)
    answers = bucketed(cells.groupBy("range").applyInArrow(_answer, ANSWER), "block", "lm_counts", buckets, deal=True)
    sums = answers.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("total", "types", "once", "twice")]).first()
    total, types = sums["total"], sums["types"]
    discount = sums["once"] / (sums["once"] + 2 * sums["twice"]) if sums["once"] else 0.5
    of_block = answers.select("block", "order", "range", "n").groupBy("block")
    events = by_block.cogroup(of_block).applyInArrow(_novelty(bits), "order int, bucket int, events long, single long")
    # at most 64 rows an order
    weight = state_weights(events.groupBy("order", "bucket").agg(F.sum("events"), F.sum("single")).collect())
    scored = by_block.cogroup(of_block).applyInArrow(
        _score(bits, total, types, discount, weight), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    )
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
