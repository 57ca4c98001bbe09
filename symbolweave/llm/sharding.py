"""Sharding by global byte-size prefix sums, cut at equal targets into contiguous balanced shards.

One pass over the documents writes a size table with running sums within each partition; the partitions' totals (one
row a partition) give each partition its global offset, and a row's shard is the one whose equal share of the bytes
holds the row's first byte. No document is shuffled, and a shard's size is off its share by less than one document.

Edge cases: a null text has no bytes; repeated rows take a slot each; with fewer bytes than shards some shards stay
empty; an empty table gives an empty result. The order that shards are cut from is that of the scan, as written down.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symbolweave.llm.common import save

SHARDS = 8


def _running(batches):
    """Adds the bytes and rows of the partition that come before each row."""
    size_before = rows_before = 0
    for b in batches:
        sums = pc.cumulative_sum(b.column("size"))
        before = pc.add(pc.subtract(sums, b.column("size")), size_before)
        rows = pa.array(range(rows_before, rows_before + b.num_rows), pa.int64())
        yield pa.RecordBatch.from_arrays([*b.columns, before, rows], [*b.schema.names, "bytes_before", "rows_before"])
        if b.num_rows:
            size_before += sums[-1].as_py()
            rows_before += b.num_rows


def size_table(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, part, bytes_before, rows_before: written, so the order of rows is fixed."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.spark_partition_id().alias("part"),
    )
    return save(sized.mapInArrow(_running, "doc_id long, size long, text_crc32 long, part int, bytes_before long, rows_before long"), "shard-sizes")


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, start_byte for each row of docs."""
    sizes = size_table(docs)
    parts = sizes.groupBy("part").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")).orderBy("part").collect()
    offsets, at, row = [], 0, 0
    for p in parts:
        offsets.append((p["part"], at, row))
        at, row = at + p["size"], row + p["rows"]
    spark, share = docs.sparkSession, max(1, -(-at // shards))
    side = spark.createDataFrame(offsets, "part int, part_byte long, part_row long")
    placed = sizes.join(F.broadcast(side), "part").select(
        "doc_id", "size", "text_crc32",
        (F.col("bytes_before") + F.col("part_byte")).alias("start_byte"), (F.col("rows_before") + F.col("part_row")).alias("row"),
    )
    placed = placed.withColumn("shard", F.floor(F.col("start_byte") / share).cast("int"))
    firsts = save(placed.groupBy("shard").agg(F.min("row").alias("first_row")), "shard-firsts")
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first_row")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "start_byte",
    )
