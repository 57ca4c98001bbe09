"""Packing by concatenate and cut.

Pass one tokenises each partition's documents once, writes their ids with each document's offset within its partition,
and totals the partitions; prefix sums over those totals (one row a partition) give every document its global offset.
Pass two cuts the written ids at fixed windows of seq_len tokens: a document that straddles windows yields a piece,
a boundary record, for each. Nothing shuffles; all sequences but the last are full.

Edge cases: a null or empty text is its end token alone; repeated rows are packed once each; very long documents span
many sequences; an empty table gives an empty result. A literal of an added token in a text (<|endoftext|>) becomes
that token's id, as byte_bpe_50k.json has it.
"""

from __future__ import annotations

import base64
import json
import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symbolweave.llm.common import runs, save, tidy

SEQ_LEN, END_ID = 2048, 1
#: Entries of a worker's cache of encoded words; past it the cache starts anew.
CACHE_WORDS = 120_000
SPACE_RUN = re.compile(r" (?:\s|$)")


def vocabulary_path() -> str:
    """The byte-level BPE vocabulary as ranks; its ids are those of byte_bpe_50k.json."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def added_tokens() -> dict[str, int]:
    """The added tokens of byte_bpe_50k.json; none has a condition on what stands beside it."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


class WordEncoder(dict):
    """Ids of a text without added tokens, as little-endian uint16 or uint32 bytes, from a cache keyed by the piece between two spaces.

    The pattern of the vocabulary always starts a piece at a space that stands before a visible character, so such a
    text is the concatenation of its space-led pieces. Any other text is encoded whole.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.wide = max(ranks.values()) > 0xFFFF
        self.dtype = np.dtype("<u4" if self.wide else "<u2")

    def whole(self, text: str) -> bytes:
        return array("I" if self.wide else "H", self.encoding.encode_ordinary(text)).tobytes()

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        found = self.whole(" " + piece)
        if len(piece) < 64:
            self[piece] = found
        return found

    def encode(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        if not rest:
            return self.whole(text)
        # a space before white space, or at the end, belongs to no piece of its own: such pieces join their predecessor
        if SPACE_RUN.search(text):
            joined = [first]
            for p in rest:
                if p and not p[0].isspace():
                    joined.append(p)
                else:
                    joined[-1] += " " + p
            first, rest = joined[0], joined[1:]
        return self.whole(first) + b"".join(map(self.__getitem__, rest))


class TextEncoder:
    """Ids of a text as the tokenizer of byte_bpe_50k.json gives them: added tokens are cut out before the rest is encoded."""

    def __init__(self, path: str, added: dict[str, int]):
        self.words = WordEncoder(path)
        self.wide = self.words.wide or max(added.values(), default=0) > 0xFFFF
        self.dtype = np.dtype("<u4" if self.wide else "<u2")
        self.added = {t: np.array([i], self.dtype).tobytes() for t, i in added.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

    def _ordinary(self, text: str) -> bytes:
        ids = self.words.encode(text)
        return ids if self.words.dtype == self.dtype else np.frombuffer(ids, self.words.dtype).astype(self.dtype).tobytes()

    def encode(self, text: str) -> bytes:
        if not any(t in text for t in self.added):
            return self._ordinary(text)
        return b"".join(self.added.get(x) or self._ordinary(x) for x in self.cut.split(text) if x)


def _tokenise(path: str, added: dict[str, int], end_id: int):
    def run(batches):
        encoder, at = TextEncoder(path, added), 0
        end = np.array([end_id], encoder.dtype).tobytes()
        width = encoder.dtype.itemsize
        for b in batches:
            for lo, texts in runs(b.column("text")):
                part = b.slice(lo, len(texts))
                ids = [encoder.encode(t) + end for t in texts]
                counts = np.array([len(x) // width for x in ids], np.int64)
                before = at + np.cumsum(counts) - counts
                at += int(counts.sum())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("part"), pa.array(before), pa.array(counts), pa.array(ids, pa.binary())],
                    ["doc_id", "part", "tokens_before", "doc_tokens", "ids"],
                )

    return run


def token_table(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """doc_id, part, tokens_before (in the partition), doc_tokens, ids (uint16 if the vocabulary allows): written once."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.spark_partition_id().alias("part"), "text")
    return save(rows.mapInArrow(tidy(_tokenise(path or vocabulary_path(), added_tokens() if path is None else {}, end_id)), "doc_id long, part int, tokens_before long, doc_tokens long, ids binary"), "pack-tokens")


def _cut(seq_len: int, dtype: str, with_ids: bool):
    def run(batches):
        for b in batches:
            for lo, found in runs(b.column("ids")):
                part = b.slice(lo, len(found))
                out = []
                for doc, first, ids in zip(part.column("doc_id").to_pylist(), part.column("first").to_pylist(), found, strict=True):
                    ids = np.frombuffer(ids, dtype).astype("<u4")
                    n, start = len(ids), 0
                    while start < n:
                        offset = (first + start) % seq_len
                        length = min(n - start, seq_len - offset)
                        piece = ids[start : start + length].tobytes()
                        out.append((doc, start, length, zlib.crc32(piece), n, (first + start) // seq_len, offset, piece if with_ids else None))
                        start += length
                cols = list(zip(*out, strict=True))
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
                kinds = [pa.int64()] * 7 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols[: 7 + with_ids], kinds, strict=False)], names[: 7 + with_ids])

    return run


def pack(docs: DataFrame, seq_len: int = SEQ_LEN, path: str | None = None, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with_ids: its ids as uint32 bytes."""
    tokens = token_table(docs, path, end_id)
    totals = tokens.groupBy("part").agg(F.sum("doc_tokens").alias("tokens"), F.max(F.length("ids") / F.col("doc_tokens")).alias("width")).orderBy("part").collect()
    offsets, at = [], 0
    for t in totals:
        offsets.append((t["part"], at))
        at += t["tokens"]
    dtype = "<u4" if any(t["width"] > 2 for t in totals) else "<u2"
    side = docs.sparkSession.createDataFrame(offsets, "part int, part_first long")
    placed = tokens.join(F.broadcast(side), "part").select("doc_id", (F.col("part_first") + F.col("tokens_before")).alias("first"), "ids")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    return placed.mapInArrow(tidy(_cut(seq_len, dtype, with_ids)), schema)
