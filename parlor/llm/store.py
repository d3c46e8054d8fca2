"""Tables in the shared folder: they cut lineage, survive the loss of executors, and are read again by column."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only in local mode (tests), else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="llm-")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """The rows of ``df``, computed once, written to the shared folder and read back."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of this session take 8 MB at most (or one row): a Python task holds a batch and what it makes of it."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)
