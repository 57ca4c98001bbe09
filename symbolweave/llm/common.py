"""Shared plumbing of the training-data operators: shared storage, input tables, vectorised word hashing."""

from __future__ import annotations

import ctypes
import hashlib
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symbolweave.runtime import cut as save
from symbolweave.runtime import shared_dir

#: Text bytes that one numpy pass works on; bounds a Python worker's memory whatever the Arrow batch holds.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever the case of letters, as Spark takes names."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(columns: list[str]) -> list[Column]:
    """The columns of these names, taken literally: dots and backticks are part of a name."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def held_out(id_col, mod: int):
    """crc32 of the id as text, modulo mod, is 0; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % mod == 0


#: Fixed constants of our polynomial hash over Z/2^64: an odd base and its inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
        done += step
    return out


_POW: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW.get("base", ())) < n:
        size = max(n, CHUNK_BYTES + 4096)
        _POW["base"], _POW["inverse"] = _powers(BASE, size), _powers(INVERSE, size)
    return _POW["base"], _POW["inverse"]


def byte_codes(fold_case: bool) -> np.ndarray:
    """A fixed random 64-bit code for each byte; with fold_case, A-Z share the codes of a-z."""
    codes = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    if fold_case:
        codes[65:91] = codes[97:123]
    return codes


FOLDED, EXACT = byte_codes(True), byte_codes(False)


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def prefix_hash(buf: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Prefix sums S with S[j]-S[i] = BASE^i * hash(buf[i:j])."""
    base, _ = powers(len(buf) + 1)
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(codes[buf] * base[: len(buf)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, inverse = powers(len(prefix))
    return mix64((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64))


def chunks(texts: list, limit: int = CHUNK_BYTES):
    """Consecutive runs of texts (bytes, None as empty) of at most limit bytes, or one longer text: (first index, texts)."""
    first, run, size = 0, [], 0
    for i, t in enumerate(texts):
        t = t or b""
        if run and size + len(t) + 1 > limit:
            yield first, run
            first, run, size = i, [], 0
        run.append(t)
        size += len(t) + 1
    if run:
        yield first, run


def runs(column: pa.Array, limit: int = CHUNK_BYTES):
    """chunks() of an Arrow column: (first index, values), nulls as empty; only one run at a time is Python objects."""
    empty = "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64) + 1)
    lo = 0
    while lo < len(column):
        hi = max(int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + limit, "right")), lo + 1)
        yield lo, [t or empty for t in column.slice(lo, hi - lo).to_pylist()]
        lo = hi


#: Words of more bytes are hashed one by one: over 2^64, a polynomial gives certain strings of 1024 bytes and more (Thue-Morse) one hash.
LONG_WORD = 256


def words(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Words ([^ \\t-\\r]+, A-Z folded) of all texts: their 64-bit hashes in order, and each text's number of words."""
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    inside = (buf != 32) & ((buf < 9) | (buf > 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside))))
    start, end = edge[::2], edge[1::2]
    hashes = range_hash(prefix_hash(buf, FOLDED), start, end)
    for i in np.flatnonzero(end - start > LONG_WORD):
        hashes[i] = int.from_bytes(hashlib.blake2b(buf[start[i] : end[i]].tobytes().lower(), digest_size=8).digest(), "little")
    bounds = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.diff(np.searchsorted(start, bounds), prepend=0)


#: Text bytes of a block: what one task holds at once where documents must meet rows computed elsewhere.
BLOCK_BYTES = 16 << 20


def bucket_count(df: DataFrame) -> int:
    """Buckets for what is made of df: one for each partition of its scan (some 128 MB each), at least as many as shuffles have."""
    return min(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions(), 1), 100_000)


def bucketed(df: DataFrame, key: str, tag: str, buckets: int, deal: bool = False) -> DataFrame:
    """Writes df to shared storage bucketed by key, so that later joins and cogroups by key don't shuffle it.

    deal: rows of a key come from many tasks; they are shuffled first, so that each bucket is one file. The catalog
    holds the table only until its plan is made.
    """
    spark = df.sparkSession
    name = f"symbolweave_{tag}_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, key) if deal else df
    dealt.write.bucketBy(buckets, key).option("compression", "zstd").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return out


def tidy(run):
    """run, a function for mapInArrow; at a partition's end a worker, which stays for later stages, gives freed memory back."""

    def whole(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        libc = ctypes.CDLL(None)
        if hasattr(libc, "malloc_trim"):
            libc.malloc_trim(0)

    return whole


def partition_id() -> int:
    from pyspark import TaskContext

    found = TaskContext.get()
    return found.partitionId() if found else 0
