"""Many keys under one processor call: keys are dealt to shards by hash, and a shard keeps its keys' rows as one compressed table in its state.

A call per key costs several round trips between Spark and Python and a table of one row; a call per shard costs the same for all its keys of a batch,
which are then worked on by columns. A batch reads and writes the shards that its rows fall into. The number of shards belongs to the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlor.streaming.outputs import State

SHARDS = 512


def by_shard(rows: DataFrame, keys: Sequence[str], shards: int = SHARDS):
    return rows.withColumn("shard", F.pmod(F.xxhash64(*keys), F.lit(shards)).cast("int")).groupBy("shard")


def arrow_schema(columns: str) -> pa.Schema:
    """``name type, …`` of strings and whole numbers, without a session, as workers have none."""
    kinds = {"string": pa.string(), "bigint": pa.int64()}
    return pa.schema([(name, kinds[kind]) for name, kind in (column.split() for column in columns.split(","))])


def pack(rows: pd.DataFrame, schema: pa.Schema) -> bytes:
    batch = pa.RecordBatch.from_pandas(rows, schema=schema, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(data: bytes | None, schema: pa.Schema) -> pd.DataFrame:
    """The rows of a shard with whole numbers as such, so that none is rounded where some are null."""
    table = schema.empty_table() if data is None else pa.ipc.open_stream(data).read_all()
    return table.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)


def whole(rows: Iterable[pd.DataFrame], columns: Sequence[str], numbers: Sequence[str]) -> pd.DataFrame:
    """The rows of a call as one table, its numbers whole where some are null."""
    return pd.concat([frame[list(columns)] for frame in rows], ignore_index=True).astype({c: "Int64" for c in numbers})


def number(rows: pd.DataFrame, keys: Sequence[str]) -> np.ndarray:
    """Keys as numbers from 0 in order of appearance; null is a value."""
    return rows.groupby(list(keys), dropna=False, sort=False).ngroup().to_numpy()


class ShardState(State):
    """The packed rows of all shards, as rows."""

    def __init__(self, spark, checkpoint: str, variable: str, schema: str):
        super().__init__(spark, checkpoint, variable)
        self.schema = schema

    def read(self) -> DataFrame:
        def rows(batches):
            for batch in batches:
                for data in batch.column("rows").to_pylist():
                    yield from pa.ipc.open_stream(data)

        return super().read().select("rows").mapInArrow(rows, self.schema)
