"""Where loops cut their lineage: tables written to the cluster's shared folder."""

from __future__ import annotations

import gc
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_OPEN: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in spark.checkpoint.dir, or in the warehouse where that is unset; it goes when the driver ends."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    root = (found or spark.conf.get("spark.sql.warehouse.dir") + "/_work").rstrip("/")
    path = f"{root}/symbolweave-{spark.sparkContext.applicationId}"
    if path not in _OPEN:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = place.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(place)
        files.deleteOnExit(place)
        _OPEN.add(path)
    return path


def cut(df: DataFrame, tag: str) -> DataFrame:
    """df written and read again: later plans start from the written table, whatever executors are lost."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_shuffles(spark: SparkSession) -> None:
    """Spark deletes the shuffle files of plans that are garbage on the driver: collected now, as the next step needs the disk."""
    spark.range(1).count()  # its listeners hold the plan of the last query until another ends
    time.sleep(0.2)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def is_empty(df: DataFrame) -> bool:
    return df.limit(1).count() == 0
