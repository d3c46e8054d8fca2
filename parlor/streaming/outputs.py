"""Where streams leave their results: a Parquet folder by micro-batch, or the state that Spark keeps for the query."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class Output:
    """Rows that a stream has written, partitioned by micro-batch: a repeated batch replaces its own rows. With keys, the newest batch of a key counts."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str] = ()):
        self.spark, self.path, self.schema, self.keys = spark, path, f"{schema}, batch bigint", list(keys)
        spark.createDataFrame([], self.schema).write.mode("append").partitionBy("batch").parquet(path)  # readers may come before the first row

    def write(self, rows: DataFrame, batch: int) -> None:
        numbered = rows.withColumn("batch", F.lit(batch).cast("bigint"))
        numbered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(self.path)

    def read(self) -> DataFrame:
        rows = self.spark.read.schema(self.schema).parquet(self.path)
        if not self.keys:
            return rows.drop("batch")
        values = [c for c in rows.columns if c not in self.keys and c != "batch"]
        return rows.groupBy(*self.keys).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*self.keys, "v.*")


class State:
    """One state variable of a query, read from its checkpoint with Spark's state reader: the keys with their values after the last batch."""

    def __init__(self, spark: SparkSession, checkpoint: str, variable: str):
        self.spark, self.checkpoint, self.variable = spark, checkpoint, variable

    def read(self) -> DataFrame:
        return self.spark.read.format("statestore").option("stateVarName", self.variable).load(self.checkpoint).select("key.*", "value.*")


class state_on_disk:
    """Queries started inside keep their state in RocksDB, so it may outgrow memory and a batch writes only what it changed."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> None:
        self.before = self.spark.conf.get(_PROVIDER)
        self.spark.conf.set(_PROVIDER, ROCKSDB)
        self.spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")

    def __exit__(self, *_) -> None:
        self.spark.conf.set(_PROVIDER, self.before)
