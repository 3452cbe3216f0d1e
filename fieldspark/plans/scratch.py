"""Tables in the cluster's shared folder: results that are computed once and survive lost executors."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows (narrow ones) that may be broadcast.
BROADCAST_ROWS = 200_000


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, removed when the application ends.

    The setting is read from the session. Where it is unset, a local session gets a folder below its warehouse; on a cluster
    other executors might not see that folder, so there the setting is required.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet to the shared folder and read again: computed once, and safe when executors are lost."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def if_small(df: DataFrame) -> DataFrame:
    """`df` (narrow and cheap to evaluate), to be broadcast if its counted rows allow, and else never: Spark would judge it by its compressed files."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df.hint("merge")


def materialise_by(df: DataFrame, key: str, name: str) -> DataFrame:
    """materialise() as a table bucketed by `key`: a later grouping or join by the key reads it without a shuffle."""
    spark = df.sparkSession
    table = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.option("compression", "zstd").option("path", scratch_path(spark, name)).bucketBy(buckets, key).saveAsTable(table)
    return spark.table(table)
