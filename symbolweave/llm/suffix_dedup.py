"""Exact substring dedup over a partitioned suffix array, sorted deep-shallow.

A byte goes if a string of LENGTH bytes that covers it starts earlier in the corpus too. Every window of LENGTH bytes
has an anchor, the leftmost smallest hash among its GRAM-byte grams, which equal windows share at the same offset. So
the windows of the corpus fall into bins by their anchor gram, and only grams seen twice can hold equal windows. Each
such bin's windows are suffixes of the text, cut at LENGTH, and sorted deep-shallow: multikey quicksort over 8-byte
symbols to SHALLOW bytes, then a blind trie for each group that still ties. Equal neighbours in the sorted order
are repeats; the earliest by (doc_id, row, offset) stays.

Before bins meet, a block of documents folds anchors whose whole context (all bytes of the anchor's windows) is equal,
byte by byte, into their first, so a passage in a third of all documents sends one record a block; across blocks the
same is done by 64-bit hashes of both the gram and the context, without a look at the bytes. Only grams that then still have different contexts are sorted. A gram with more
than HOT contexts is resolved by its windows' 128-bit hashes, folded again by block: no bin outgrows a task.
The text is written once, bucketed by block, and never shuffles.

Edge cases: null and empty texts have no bytes; texts under LENGTH bytes keep everything; a null doc_id counts as the
smallest; among rows that repeat a doc_id the scan's order decides; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symbolweave.llm.common import BLOCK_BYTES, EXACT, bucket_count, bucketed, chunks, mix64, partition_id, prefix_hash, range_hash, save

LENGTH, GRAM, SHALLOW, HOT = 100, 32, 32, 4096
REACH = LENGTH - GRAM  # the largest offset of an anchor in its window
WIDTH = LENGTH + REACH  # bytes of the longest context
#: A bin's records are sorted in runs of about so many.
RUN = 4096
#: Byte codes of the fingerprints, unlike those of the gram hashes.
_CONTROL = mix64(EXACT)


def _blocks(block_bytes: int):
    def run(batches):
        number, row, size = 0, 0, 0
        for b in batches:
            ids, texts = b.column("doc_id"), b.column("text")
            blocks, rows = [], []
            for n in [len(t) for t in texts.to_pylist()]:
                if size and size + n > block_bytes:
                    number, row, size = number + 1, 0, 0
                blocks.append((partition_id() << 24) + number)
                rows.append(row)
                row, size = row + 1, size + n
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(rows, pa.int32()), ids, texts], ["block", "row", "doc_id", "text"])

    return run


def anchors(texts: list):
    """For each run of windows with one anchor: text index, anchor, how far left of it windows start at most and at least, hash of its gram, fingerprint of its context."""
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    buf = np.frombuffer(b"".join(texts), np.uint8)
    none = [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 2
    if len(buf) < LENGTH:
        return none
    prefix = prefix_hash(buf, EXACT)
    at = np.arange(len(buf) - GRAM + 1)
    h = range_hash(prefix, at, at + GRAM)
    low, span = h, 1
    while span * 2 <= REACH + 1:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    rest = REACH + 1 - span
    low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low  # low[q]: smallest hash of q .. q+REACH
    n = len(buf) - LENGTH + 1
    low = low[:n]
    inside = np.zeros(n + 1, np.int32)
    long = sizes >= LENGTH
    starts = (ends - sizes)[long]
    np.add.at(inside, starts, 1)
    np.add.at(inside, np.minimum((ends - LENGTH + 1)[long], n), -1)
    valid = np.cumsum(inside[:-1]) > 0
    new = np.ones(n, bool)
    new[1:] = (low[1:] != low[:-1]) | ~valid[:-1]
    new[starts] = True
    q0 = np.flatnonzero(new & valid)
    if not len(q0):
        return none
    stop = np.flatnonzero((new | ~valid)[1:]) + 1
    q1 = np.append(stop, n)[np.searchsorted(stop, q0, side="right")] - 1
    a = np.empty(len(q0), np.int64)
    for lo in range(0, len(q0), 16384):
        q = q0[lo : lo + 16384]
        a[lo : lo + 16384] = q + np.argmax(h[q[:, None] + np.arange(REACH + 1)] == low[q][:, None], axis=1)
    past = np.flatnonzero(q1 > a)
    if len(past):  # periodic text: the same smallest gram comes again before its windows end
        length = q1[past] - q0[past] + REACH + 1
        owner = np.repeat(past, length)
        p = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + q0[owner]
        same = h[p] == low[q0[owner]]
        p, owner = p[same], owner[same]
        before = np.full(len(p), -1)
        before[1:] = np.where(owner[1:] == owner[:-1], p[:-1], -1)
        s0, s1 = np.maximum(before + 1, q0[owner]), np.minimum(p, q1[owner])
        good = s0 <= s1
        whole = np.flatnonzero(q1 <= a)
        q0, q1, a = (np.concatenate(x) for x in ((q0[whole], s0[good]), (q1[whole], s1[good]), (a[whole], p[good])))
    doc = np.searchsorted(ends, q0, side="right")
    first = (ends - sizes)[doc]
    return [doc, a - first, a - q0, a - q1, h[a], range_hash(prefix_hash(buf, _CONTROL), q0, q1 + LENGTH)]


#: spot holds pos, left and right of an anchor in one number.
ANCHOR = "hash long, print long, doc_id long, block long, row int, spot long, copies binary"


def _spot(pos, left, right):
    return pos << 16 | left << 8 | right


def _unspot(spot):
    return spot >> 16, spot >> 8 & 255, spot & 255


def _differ(texts: list, row: np.ndarray, start: np.ndarray, size: np.ndarray, items: np.ndarray) -> np.ndarray:
    """Of items, which have other bytes than the item before: size bytes of a text from start."""
    buf = np.frombuffer(b"".join(texts), np.uint8)
    words = np.ndarray(max(len(buf) - 7, 0), "<u8", buf, strides=(1,))
    at = (np.cumsum([len(t) for t in texts]) - [len(t) for t in texts])[row] + start
    a, b, last = at[items], at[items - 1], size[items] - 8
    out = np.zeros(len(items), bool)
    for o in range(0, WIDTH, 8):
        step = np.minimum(o, last)
        out |= words[a + step] != words[b + step]
    return out


def _anchor_rows(block_bytes: int):
    """Anchors of blocks of documents, equal contexts folded into the first; copies: (row, pos, left, right) of the others."""

    def flush(block, parts, ids, texts):
        row, pos, left, right, h, f = (np.concatenate(x) for x in zip(*parts, strict=True))
        doc = np.array([np.iinfo(np.int64).min if i is None else i for i in ids[0]])[row - ids[1]]
        order = np.lexsort((pos, row, doc, right, left, f, h))
        row, pos, left, right, h, f, doc = (x[order] for x in (row, pos, left, right, h, f, doc))
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (f[1:] != f[:-1]) | (left[1:] != left[:-1]) | (right[1:] != right[:-1])
        again = np.flatnonzero(~new)
        new[again[_differ(texts, row - ids[1], pos - left, left - right + LENGTH, again)]] = True
        first = np.flatnonzero(new)
        more = np.diff(np.append(first, len(h)))
        packed = np.stack([row, pos, left, right], axis=1).astype("<i4")
        copies = [packed[i + 1 : i + m].tobytes() if m > 1 else None for i, m in zip(first.tolist(), more.tolist(), strict=True)]
        spot = _spot(pos.astype(np.int64), left.astype(np.int64), right.astype(np.int64))
        cols = [h.view(np.int64)[first], f.view(np.int64)[first], doc[first], np.full(len(first), block), row[first].astype(np.int32), spot[first]]
        out = pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(copies, pa.binary())], [c.split()[0] for c in ANCHOR.split(", ")])
        for lo in range(0, out.num_rows, 65536):
            yield out.slice(lo, 65536)

    def run(batches):
        block, first, parts, ids, size, held = None, 0, [], [], 0, []
        for b in batches:
            blocks, rows, docs, texts = (b.column(c).to_pylist() for c in ("block", "row", "doc_id", "text"))
            cut = [0, *(i for i in range(1, len(blocks)) if blocks[i] != blocks[i - 1]), len(blocks)]
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                if lo == hi:
                    continue
                if parts and (blocks[lo] != block or size >= block_bytes):
                    yield from flush(block, parts, (ids, first), held)
                    parts = []
                if not parts:
                    block, first, ids, size, held = blocks[lo], rows[lo], [], 0, []
                for at, some in chunks(texts[lo:hi]):
                    doc, *found = anchors(some)
                    parts.append([doc + rows[lo + at], *found])
                ids += docs[lo:hi]
                held += texts[lo:hi]
                size += sum(map(len, texts[lo:hi]))
        if parts:
            yield from flush(block, parts, (ids, first), held)

    return run


RECORD = "kind int, hash long, hash2 long, doc_id long, block long, row int, pos int, left int, right int, context binary"
SPAN = "block long, row int, start int, stop int"


def _records(text: pa.Table, found: pa.Table) -> pa.Table:
    """For a block's repeated anchors: contexts (kind 0), spans of folded copies (1), hashed windows of hot grams (2)."""
    schema = pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[k]) for n, k in (c.split() for c in RECORD.split(", "))])
    if not text.num_rows or not found.num_rows:
        return schema.empty_table()
    texts = dict(zip(text.column("row").to_pylist(), text.column("text").to_pylist(), strict=True))
    block, rows, hot = text.column("block")[0].as_py(), [], []
    for r in found.to_pylist():
        r["pos"], r["left"], r["right"] = p, left, right = _unspot(r["spot"])
        if r["copies"]:
            for row, *at in np.frombuffer(r["copies"], "<i4").reshape(-1, 4).tolist():
                rows.append((1, 0, 0, 0, block, row, *at, None))
        if r["turn"] > 1:  # an earlier block has the same context
            rows.append((1, 0, 0, 0, block, r["row"], p, left, right, None))
        elif r["contexts"] > HOT:
            hot.append(r)
        elif r["contexts"] > 1:
            rows.append((0, r["hash"], 0, r["doc_id"], block, r["row"], p, left, right, texts[r["row"]][p - left : p - right + LENGTH]))
    best, lost = {}, []
    for r in hot:
        context = texts[r["row"]][r["pos"] - r["left"] : r["pos"] - r["right"] + LENGTH]
        for d in range(r["left"], r["right"] - 1, -1):
            lo = r["left"] - d
            digest = hashlib.blake2b(context[lo : lo + LENGTH], digest_size=16).digest()
            place = (r["doc_id"], r["row"], r["pos"] - d)
            kept = best.setdefault(digest, place)
            if place < kept:
                best[digest], place = place, kept
            if place != kept or place != best[digest]:
                lost.append(place)
    rows += [(1, 0, 0, 0, block, row, pos, 0, 0, None) for _, row, pos in lost]
    for digest, (doc, row, pos) in best.items():
        h1, h2 = np.frombuffer(digest, "<i8").tolist()
        rows.append((2, h1, h2, doc, block, row, pos, 0, 0, None))
    if not rows:
        return schema.empty_table()
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def multikey_quicksort(symbols, bins: np.ndarray, limit: int):
    """Sorts items within bins by symbols(items, depth) for depths below limit, all bins at once.

    Each round takes one pivot a bin and splits it three ways; the equal part goes one symbol deeper. Returns the
    items in order and the final bins: items of one bin tie on all symbols.
    """
    items = np.arange(len(bins))
    order = np.argsort(bins, kind="stable")
    items, bins = items[order], np.unique(bins[order], return_inverse=True)[1].astype(np.int64)
    depth = np.zeros(len(items), np.int64)
    while True:
        size = np.bincount(bins)
        live = np.flatnonzero((size[bins] > 1) & (depth < limit))
        if not len(live):
            return items, bins
        b = bins[live]
        first = np.ones(len(b), bool)
        first[1:] = b[1:] != b[:-1]
        group = np.cumsum(first) - 1
        starts = np.flatnonzero(first)
        key = symbols(items[live], depth[live])
        count = np.diff(np.append(starts, len(b)))
        pivot = key[starts + count // 2][group]
        part = (key > pivot).astype(np.int64) * 2 + (key == pivot)
        order = np.argsort(group * 3 + part, kind="stable")
        items[live] = items[live][order]
        depth[live] = depth[live][order] + (part[order] == 1)
        fine = bins * 3
        fine[live] += part[order]
        new = np.ones(len(fine), bool)
        new[1:] = fine[1:] != fine[:-1]
        bins = np.cumsum(new) - 1


class BlindTrie:
    """Orders equally long strings by a trie that stores only the positions and bytes that tell them apart.

    An insertion descends blindly to some leaf, compares once with its string, and branches where they part; equal
    strings share a leaf.
    """

    def __init__(self, first: bytes, item: int):
        self.root = [-1, first, [item]]

    def insert(self, s: bytes, item: int) -> None:
        node = self.root
        while node[0] >= 0:
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        other = node[1]
        if other == s:
            node[2].append(item)
            return
        x = int.from_bytes(s) ^ int.from_bytes(other)
        at = len(s) - (x.bit_length() + 7) // 8
        node = self.root
        while 0 <= node[0] < at:
            node = node[1][s[node[0]]]
        if node[0] == at:
            node[1][s[at]] = [-1, s, [item]]
        else:
            node[:] = [at, {other[at]: node[:], s[at]: [-1, s, [item]]}, None]

    def leaves(self):
        """Lists of items with equal strings, in the strings' order."""
        stack = [self.root]
        while stack:
            node = stack.pop()
            if node[0] < 0:
                yield node[2]
            else:
                stack.extend(node[1][b] for b in sorted(node[1], reverse=True))


def deep_shallow(matrix: np.ndarray, record: np.ndarray, column: np.ndarray, bins: np.ndarray):
    """Groups of windows (indexes) that are equal, in each bin's sorted order. A window is LENGTH bytes of matrix[record] from column."""
    wide = np.zeros((len(matrix), WIDTH - 7), np.uint64)
    for i in range(8):
        wide = (wide << np.uint64(8)) | matrix[:, i : i + WIDTH - 7]
    items, tied = multikey_quicksort(lambda x, depth: wide[record[x], column[x] + 8 * depth], bins, SHALLOW // 8)
    size = np.bincount(tied)
    ends = np.cumsum(size)
    flat = matrix.tobytes()
    place = record * WIDTH + column + SHALLOW
    for b in np.flatnonzero(size > 1):
        group = items[ends[b] - size[b] : ends[b]].tolist()
        spots = place[group].tolist()
        trie = BlindTrie(flat[spots[0] : spots[0] + LENGTH - SHALLOW], group[0])
        for item, spot in zip(group[1:], spots[1:], strict=True):
            trie.insert(flat[spot : spot + LENGTH - SHALLOW], item)
        for leaf in trie.leaves():
            if len(leaf) > 1:
                yield leaf


def repeats(rows: list[dict]):
    """(block, row, start, stop) of what repeats among contexts of whole bins."""
    rows.sort(key=lambda r: (r["doc_id"], r["block"], r["row"], r["pos"]))  # an index is now a rank
    classes: dict = {}
    for i, r in enumerate(rows):
        if classes.setdefault((r["hash"], r["left"], r["context"]), i) != i:
            yield r["block"], r["row"], r["pos"] - r["left"], r["pos"] - r["right"] + LENGTH
    members: dict = {}
    for (h, _, _), i in classes.items():
        members.setdefault(h, []).append(i)
    groups = [g for g in members.values() if len(g) > 1]
    if not groups:
        return
    kept = [i for g in groups for i in g]
    matrix = np.zeros((len(kept), WIDTH), np.uint8)
    for j, i in enumerate(kept):
        c = rows[i]["context"]
        lo = REACH - rows[i]["left"]
        matrix[j, lo : lo + len(c)] = np.frombuffer(c, np.uint8)
    left, right = (np.array([rows[i][x] for i in kept]) for x in ("left", "right"))
    count = left - right + 1
    record = np.repeat(np.arange(len(kept)), count)
    d = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + right[record]
    bins = np.repeat(np.arange(len(groups)), [len(g) for g in groups])[record] * (REACH + 1) + d
    rank = np.array(kept)[record]
    lost = []
    for leaf in deep_shallow(matrix, record, REACH - d, bins):
        first = min(leaf, key=rank.__getitem__)
        lost.extend(x for x in leaf if x != first)
    if not lost:
        return
    lost = np.array(sorted(lost))  # by record, then offset
    rec, off = record[lost], d[lost]
    new = np.ones(len(lost), bool)
    new[1:] = (rec[1:] != rec[:-1]) | (off[1:] != off[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(lost)) - 1
    for i, lo, hi in zip(rec[first].tolist(), off[first].tolist(), off[last].tolist(), strict=True):
        r = rows[kept[i]]
        yield r["block"], r["row"], r["pos"] - hi, r["pos"] - lo + LENGTH


def _sort_bins(batches):
    """Spans that repeat, from contexts that come ordered by hash."""

    def spans(rows):
        out = list(repeats(rows))
        if out:
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["block", "row", "start", "stop"])

    held: list = []
    for b in batches:
        for lo in range(0, b.num_rows, RUN):
            held += b.slice(lo, RUN).to_pylist()
            if len(held) >= RUN and held[0]["hash"] != held[-1]["hash"]:
                cut = len(held)
                while held[cut - 1]["hash"] == held[-1]["hash"]:
                    cut -= 1
                yield from spans(held[:cut])
                held = held[cut:]
    if held:
        yield from spans(held)


def _merged(stop: int, spans) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def _cut(text: pa.Table, spans: pa.Table) -> pa.Table:
    by_row: dict = {}
    for row, s, e in zip(*(spans.column(c).to_pylist() for c in ("row", "start", "stop")), strict=True):
        by_row.setdefault(row, []).append((s, e))
    out = []
    for row, doc, t in zip(*(text.column(c).to_pylist() for c in ("row", "doc_id", "text")), strict=True):
        runs = _merged(len(t), by_row.get(row, ()))
        kept, at = [], 0
        for s, e in runs:
            kept.append(t[at:s])
            at = e
        kept = b"".join([*kept, t[at:]])
        out.append((doc, len(t), len(t) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), [x for r in runs for x in r]))
    kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.int64())]
    schema = pa.schema(list(zip(["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"], kinds, strict=True)))
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], schema=schema) if out else schema.empty_table()


def repeated_spans(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start and stop of each maximal removed run) for each row of docs."""
    fed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    blocks = bucketed(fed.mapInArrow(_blocks(block_bytes), "block long, row int, doc_id long, text binary"), "block", "suffix", bucket_count(fed))
    found = blocks.mapInArrow(_anchor_rows(block_bytes), ANCHOR)
    same = Window.partitionBy("hash", "print", F.col("spot") % 65536).orderBy("doc_id", "block", "row", "spot")
    found = found.repartition("hash").withColumn("turn", F.row_number().over(same))
    found = found.withColumn("contexts", F.sum((F.col("turn") == 1).cast("int")).over(Window.partitionBy("hash")))
    found = found.where("turn > 1 OR contexts > 1 OR copies IS NOT NULL").drop("print")
    records = blocks.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_records, RECORD)
    records = save(records, "suffix-records")
    folded = records.where("kind = 1").select("block", "row", (F.col("pos") - F.col("left")).alias("start"), (F.col("pos") - F.col("right") + LENGTH).alias("stop"))
    binned = records.where("kind = 0").repartition("hash").sortWithinPartitions("hash").mapInArrow(_sort_bins, SPAN)
    hot = records.where("kind = 2").select("hash", "hash2", F.struct("doc_id", "block", "row", "pos").alias("at"))
    firsts = hot.groupBy("hash", "hash2").agg(F.min("at").alias("first"))
    late = hot.join(firsts, ["hash", "hash2"]).where("at <> first").select("at.block", "at.row", F.col("at.pos").alias("start"), (F.col("at.pos") + LENGTH).alias("stop"))
    spans = folded.unionByName(binned).unionByName(late)
    return blocks.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>")
