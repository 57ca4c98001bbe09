"""Change feeds: debounced bursts and incremental maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bursts(changes: DataFrame, gap: str = "500 milliseconds", by: str = "key") -> DataFrame:
    """(key, start, end, n): changes (key, ts) that follow one another within gap, batch or streaming."""
    w = F.session_window("ts", gap)
    return changes.groupBy(by, w).agg(F.count("*").alias("n")).select(by, "session_window.start", "session_window.end", "n")


def upsert(stored: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """stored after changes (its columns and op): of each key the last by ts; op delete takes it out."""
    last = changes.groupBy(key).agg(F.max_by(F.struct(*changes.columns), "ts").alias("c")).select("c.*")
    return stored.join(last.select(key), key, "left_anti").unionByName(last.where("op <> 'delete'").select(stored.columns))


def maintain(stream: DataFrame, read_stored, write_stored, key: str, checkpoint: str):
    """Starts a query that folds each micro-batch of changes into the stored table; one pass over what is there."""

    def fold(batch: DataFrame, epoch: int) -> None:
        write_stored(upsert(read_stored(), batch, key), epoch)

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def retained(revisions: DataFrame, now: float, days: int = 7, keep: int = 5) -> DataFrame:
    """Revisions (channel, revision, published_at in seconds): all of default and release channels, of others the newest keep within days."""
    from pyspark.sql import Window

    durable = (F.col("channel") == "default") | F.col("channel").startswith("release")
    place = F.row_number().over(Window.partitionBy("channel").orderBy(F.desc("published_at"), F.desc("revision")))
    return revisions.withColumn("place", place).where(durable | ((F.col("published_at") >= now - days * 86400) & (F.col("place") <= keep))).drop("place")
