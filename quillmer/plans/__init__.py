"""Choices between physical plans with equal results."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a side that may be broadcast, and bytes of their values as text; both are measured before it is.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


#: Estimated bytes up to which an input is dealt anew to all cores: files of few row groups would keep few of them busy.
SPREAD_BYTES = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores if Spark's own estimate of its size is small; a large input has partitions enough."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= SPREAD_BYTES else df


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows and ``size`` bytes, else as it is: Spark then shuffles both sides."""
    width = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in df.columns), F.lit(8))
    got = df.limit(rows + 1).agg(F.count("*").alias("n"), F.sum(width).alias("size")).first()
    return F.broadcast(df) if got["n"] <= rows and (got["size"] or 0) <= size else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or one of our own where it is unset and all run on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (found or os.path.join(tempfile.gettempdir(), f"quillmer-{os.getuid()}")).rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below the shared folder and read back: plans that refer to it several times, or grow step by step, stay small."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(keys: DataFrame, name: str) -> DataFrame:
    """Distinct ``keys`` and, in a column ``name``, their place (from 0) in the order of all columns.

    Keys are dealt by range and numbered within each; only the ranges' sizes are added up in one place.
    """
    order = keys.columns
    dealt = written(keys.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "keys")
    sizes = sorted((r["_range"], r["count"]) for r in dealt.groupBy("_range").count().collect())  # one row a task
    before, at = [], 0
    for part, n in sizes:
        before.append((part, at))
        at += n
    offsets = F.broadcast(keys.sparkSession.createDataFrame(before, "_range int, _before long"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.withColumn("_place", place).join(offsets, "_range").select(*order, (F.col("_before") + F.col("_place") - 1).cast("long").alias(name))
