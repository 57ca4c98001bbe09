"""Exact dedup by two-pass Bloom filtering, in DataFrame functions only.

Pass one marks the slots of a blocked Bloom bitmap (a hash picks one block of BLOCK bits and two bits in it) that two or
more rows hit; pass two probes every row against it. A row with an unmarked slot has no equal anywhere and passes
straight through; only the others shuffle.

A bitmap has at most max_bits bits (32 MB), which its broadcast is bounded by. Where the rows need more, their hashes
are first dealt by prefix into parts, written, and each part gets a filter of its own, one after another, so no filter
ever fills up. Whole documents are then probed against a bitmap of the possibly repeated hashes alone; only where those
are too many for max_bits does a fuller bitmap let more rows through to the shuffle. The result is the same always.

Edge cases: a null text counts as empty; texts are compared as they are. Of equal texts the row with the largest
doc_id stays (a null doc_id is smallest); of rows that repeat both, exactly one. Columns of any name stay as they are.
An empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symbolweave.llm.common import fresh, quoted, save, shared_dir

BITS_PER_ROW, MAX_BITS = 16, 1 << 28
#: Bits of a block: those of a row of Spark's bitmap functions.
BLOCK = 32768


def _blocks(rows: int) -> int:
    """Blocks that so many rows need."""
    return max(1, -(-BITS_PER_ROW * rows // BLOCK))


def _slots(h: Column, blocks: int) -> list[Column]:
    """Two slots of a hash, in one block."""
    first = F.pmod(F.xxhash64(h, F.lit(1)), F.lit(blocks)) * BLOCK
    return [first + F.pmod(F.xxhash64(h, F.lit(i)), F.lit(BLOCK)) for i in (2, 3)]


def marked_slots(hashes: DataFrame, blocks: int, hits: int = 2) -> DataFrame:
    """(bucket, bitmap) of the slots hit at least so many times. hashes: a column h, a row for each document."""
    hit = hashes.select(F.explode(F.array(*_slots(F.col("h"), blocks))).alias("slot"))
    enough = hit.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= hits)
    return enough.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bitmap")
    )


def with_flag(df: DataFrame, h: str, bitmaps: DataFrame, blocks: int, flag: str) -> DataFrame:
    """df with the column flag: True where both slots of column h are marked."""
    bucket, bitmap = fresh(df, "bloom_bucket"), fresh(df, "bloom_bitmap")
    slots = _slots(F.col(h), blocks)
    side = bitmaps.select(F.col("bucket").alias(bucket), F.col("bitmap").alias(bitmap))
    # at most MAX_BITS / BLOCK rows of 4 KB
    joined = df.join(F.broadcast(side), F.bitmap_bucket_number(slots[0]) == F.col(bucket), "left")

    def marked(slot):
        place = F.bitmap_bit_position(slot)
        byte = F.conv(F.hex(F.substring(F.col(bitmap), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return F.coalesce((byte / F.pow(F.lit(2), place % 8)).cast("int") % 2 == 1, F.lit(False))

    return joined.select(*quoted(df.columns), (marked(slots[0]) & marked(slots[1])).alias(flag))


def flagged(rows: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """rows (h and others, written) with maybe: False only where no other row has the same h."""
    n = rows.count()
    parts = max(1, -(-_blocks(n) * BLOCK // max(max_bits, BLOCK)))
    if parts == 1:
        bitmaps = save(marked_slots(rows, _blocks(n)), "exact-bloom")
        return with_flag(rows, "h", bitmaps, _blocks(n), "maybe")
    dealt = rows.withColumn("bloom_part", F.pmod(F.xxhash64("h", F.lit(0)), F.lit(parts)))
    path = f"{shared_dir(rows.sparkSession)}/exact-parts-{uuid.uuid4().hex}"
    dealt.repartition("bloom_part", F.pmod("row", F.lit(64))).write.partitionBy("bloom_part").parquet(path)
    dealt = rows.sparkSession.read.schema(dealt.schema).parquet(path)
    blocks, out = _blocks(-(-n // parts)), []
    for p in range(parts):
        part = dealt.where(F.col("bloom_part") == p).drop("bloom_part")
        bitmaps = save(marked_slots(part, blocks), "exact-bloom")
        out.append(save(with_flag(part, "h", bitmaps, blocks, "maybe"), "exact-flagged"))
    return reduce(DataFrame.unionByName, out)


def exact_duplicates(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256."""
    text = F.coalesce(F.col("text"), F.lit(""))
    digests = save(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.sha2(text.cast("binary"), 256).alias("text_sha256"),
            F.xxhash64(text).alias("h"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "exact-digests",
    )
    marked = flagged(digests, max_bits)
    alone = marked.where(~F.col("maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    some = marked.where("maybe")
    # written, so that the join shuffles both sides and a hot group's rows can be split over tasks
    groups = save(some.groupBy("text_sha256").agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size")), "exact-groups")
    shared = some.join(groups, "text_sha256").select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"), "text_sha256"
    )
    return alone.unionByName(shared)


def drop_exact_duplicates(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """docs with one row for each distinct text and its columns as they are."""
    h, sha, flag = (fresh(docs, x) for x in ("exact_h", "exact_sha", "exact_maybe"))
    text = F.coalesce(F.col("text"), F.lit(""))
    hashes = save(docs.select(F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("row")), "exact-hashes")
    again = save(flagged(hashes, max_bits).where("maybe").select("h").distinct(), "exact-again")
    blocks = min(_blocks(again.count()), max(1, max_bits // BLOCK))
    bitmaps = save(marked_slots(again, blocks, hits=1), "exact-bloom")
    marked = with_flag(docs.withColumn(h, F.xxhash64(text)), h, bitmaps, blocks, flag)
    alone = marked.where(~F.col(flag)).select(*quoted(docs.columns))
    plain = [c for c, (_, kind) in zip(quoted(docs.columns), docs.dtypes, strict=True) if "map<" not in kind and kind != "variant"]
    best = F.max_by(F.struct(*quoted(docs.columns)), F.struct("doc_id", F.xxhash64(*plain)))
    kept = marked.where(F.col(flag)).withColumn(sha, F.sha2(text.cast("binary"), 256)).groupBy(sha).agg(best.alias("kept_row"))
    return alone.union(kept.select("kept_row.*"))
