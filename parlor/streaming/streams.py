"""Stateful behaviours as Structured Streaming jobs, each equal to its batch twin once all input is in.

State is Spark's own: built-in aggregation, whose batch reads and writes the state of its own keys only, or a processor that holds keys by shard, on RocksDB.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from parlor.operators import contact_changes as JC
from parlor.operators import room_changes as JR
from parlor.operators.message_changes import both_inboxes
from parlor.streaming.outputs import Output, state_on_disk
from parlor.streaming.shards import SHARDS, ShardState, arrow_schema, by_shard, number, pack, unpack, whole

BOX = ["owner_id", "entity_id"]


def start(stream: DataFrame, root: str, each: Callable[[DataFrame, int], None] | None = None, mode: str = "update") -> StreamingQuery:
    """An ``availableNow`` query with its checkpoint under ``root``; without ``each`` its rows go nowhere and its state is the result."""
    writer = stream.writeStream.option("checkpointLocation", f"{root}/checkpoint").outputMode(mode).trigger(availableNow=True)
    with state_on_disk(stream.sparkSession):
        return (writer.foreachBatch(each) if each else writer.format("noop")).start()


def run(query: StreamingQuery) -> None:
    """Let an ``availableNow`` query take in all present input."""
    query.awaitTermination()


def fold_stream(stream: DataFrame, keys: Sequence[str], aggregates: Sequence[Column], root: str, schema: str, columns: Sequence[str] = ("*",)) -> tuple[StreamingQuery, Output]:
    """Built-in streaming aggregation per key; each batch writes only the keys it changed.

    Fits states that do not hang on the order of rows: maxima, first and last by position, counts.
    """
    out = Output(stream.sparkSession, f"{root}/state", schema, keys)
    grouped = stream.groupBy(*keys).agg(*aggregates).select(*columns)
    return start(grouped, root, out.write), out


MESSAGE = "owner_id string, message_id string, entity_id string, author_id string, message string, sys_id bigint, ctime bigint"


def stream_messages(posts: DataFrame, root: str) -> tuple[StreamingQuery, Output]:
    """``posts(seq, ts, author_id, entity_id, message_id, message, ctime)`` once per inbox, however late they come.

    Of the rows of one message the first by ``seq`` counts, also if it comes after others; keys are kept without a watermark.
    """
    row = F.struct("entity_id", "author_id", "message", F.col("seq").alias("sys_id"), "ctime")
    return fold_stream(both_inboxes(posts), ["owner_id", "message_id"], [F.min_by(row, "seq").alias("m")], root, MESSAGE, ("owner_id", "message_id", "m.*"))


LAST = "owner_id string, entity_id string, m struct<sys_id:bigint,message:string,ctime:bigint,is_attachment:int>"


def stream_last_message(channel: DataFrame, root: str) -> tuple[StreamingQuery, Output]:
    row = F.struct("sys_id", F.left("message", F.lit(100)).alias("message"), "ctime", F.when(F.col("attachment").isNotNull(), 1).otherwise(0).alias("is_attachment"))
    return fold_stream(channel, BOX, [F.max_by(row, "sys_id").alias("m")], root, LAST)


MARKER = "owner_id string, entity_id string, uid string, ref_sys_id bigint"


def stream_markers(acks: DataFrame, root: str) -> tuple[StreamingQuery, Output]:
    """``acks(owner_id, entity_id, uid, sys_id)``: markers only rise."""
    return fold_stream(acks, [*BOX, "uid"], [F.max("sys_id").alias("ref_sys_id")], root, MARKER)


EVENT = "kind string, owner_id string, entity_id string, uid string, author_id string, message_id string, sys_id bigint"


class _Unread(StatefulProcessor):
    """State of a shard: its inboxes with their owner's marker and the count above it, and the positions above the markers by blocks of WIDTH.

    A message adds its position to one block; raised markers drop the positions below them from the blocks they have passed, so a position is added
    and taken away once, and a batch writes the blocks of its own messages and markers.
    """

    WIDTH = 1 << 20
    ROWS = "owner_id string, entity_id string, marker bigint, room_count bigint"
    NONE = np.iinfo(np.int64).min

    def init(self, handle) -> None:
        self.schema, self.places = arrow_schema(self.ROWS), arrow_schema("box bigint, sys_id bigint")
        self.state = handle.getValueState("shard", "rows binary")
        self.blocks = handle.getMapState("blocks", "block bigint", "rows binary")

    def _block(self, block: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of a block and the numbers of their inboxes."""
        found = self.blocks.containsKey((block,))
        rows = unpack(self.blocks.getValue((block,))[0] if found else None, self.places)
        return rows["sys_id"].to_numpy(np.int64), rows["box"].to_numpy(np.int64)

    def _write(self, block: int, positions: np.ndarray, box: np.ndarray) -> None:
        if len(positions):
            self.blocks.updateValue((block,), (pack(pd.DataFrame({"box": box, "sys_id": positions}), self.places),))
        else:
            self.blocks.removeKey((block,))

    def handleInputRows(self, key, rows, timerValues):
        held = unpack(self.state.get()[0] if self.state.exists() else None, self.schema)
        came = whole([held.assign(kind="held", sys_id=held["marker"]), *(frame.assign(room_count=0) for frame in rows)], [*BOX, "kind", "sys_id", "room_count"], ["sys_id", "room_count"])
        came["box"] = number(came, BOX)  # inboxes held keep their numbers
        boxes = came.drop_duplicates("box")
        marker = np.full(len(boxes), self.NONE)
        marker[:len(held)] = held["marker"].fillna(self.NONE).to_numpy(np.int64)
        count = boxes["room_count"].to_numpy(np.int64).copy()
        acks, new = came[came["kind"] == "ack"], came[came["kind"] == "message"]
        raised = marker.copy()
        np.maximum.at(raised, acks["box"].to_numpy(), acks["sys_id"].to_numpy(np.int64))
        if (raised > marker).any():
            last = int(raised[raised > marker].max()) // self.WIDTH
            for block in [b for (b,) in self.blocks.keys() if b <= last]:
                positions, box = self._block(block)
                left = positions > raised[box]
                if not left.all():
                    count -= np.bincount(box[~left], minlength=len(count))
                    self._write(block, positions[left], box[left])
        new = new[new["sys_id"].to_numpy(np.int64) > raised[new["box"].to_numpy()]]
        for block, part in new.groupby(new["sys_id"].to_numpy(np.int64) // self.WIDTH):
            positions, box = self._block(block)
            both = pd.DataFrame({"box": np.concatenate([box, part["box"].to_numpy()]), "sys_id": np.concatenate([positions, part["sys_id"].to_numpy(np.int64)])}).drop_duplicates()
            count += np.bincount(both["box"], minlength=len(count)) - np.bincount(box, minlength=len(count))
            self._write(block, both["sys_id"].to_numpy(), both["box"].to_numpy())
        now = boxes[BOX].assign(marker=pd.array(raised, "Int64"), room_count=count)
        self.state.update((pack(now.assign(marker=now["marker"].mask(raised == self.NONE)), self.schema),))
        yield from ()

    def close(self) -> None:
        pass


class UnreadCounts(ShardState):
    def read(self) -> DataFrame:
        """Inboxes whose owner has a marker."""
        return super().read().where("marker IS NOT NULL").select(*BOX, "room_count")


def stream_unread(events: DataFrame, root: str, shards: int = SHARDS) -> tuple[StreamingQuery, UnreadCounts]:
    """Unread count per inbox from ``events(kind message|ack, …)``.

    An acknowledgement may come before its message: the marker is raised, and the message counts as read on arrival. Repeated rows change nothing.
    """
    counted = events.where("kind = 'ack' AND uid = owner_id OR kind = 'message' AND author_id = entity_id").select(*BOX, "kind", "sys_id")
    state = by_shard(counted, BOX, shards).transformWithStateInPandas(_Unread(), "shard int", "Update", "None")
    return start(state, root), UnreadCounts(events.sparkSession, f"{root}/checkpoint", "shard", _Unread.ROWS)


ITEM_KEYS = ["owner_id", "entity_id", "hub_id", "category", "area"]


def stream_notifications(items: DataFrame, root: str) -> tuple[StreamingQuery, Output]:
    """Notification items as they come, counted per owner, entity, room, category and area."""
    schema = "owner_id string, entity_id string, hub_id string, category string, area string, cnt bigint, ctime bigint"
    return fold_stream(items, ITEM_KEYS, [F.sum("cnt").alias("cnt"), F.max("ctime").alias("ctime")], root, schema)


def stream_presence(events: DataFrame, root: str) -> tuple[StreamingQuery, Output]:
    """Last state per socket from ``events(socket_id, uid, state, seq, at)``."""
    schema = "socket_id string, uid string, state string, at bigint"
    return fold_stream(events, ["socket_id", "uid"], [F.max_by("state", "seq").alias("state"), F.max("at").alias("at")], root, schema)


def online_users(sockets: DataFrame, silent_since: int) -> DataFrame:
    """Users with a socket that is active and was heard of after ``silent_since``."""
    live = (F.col("state") == "active") & (F.col("at") >= silent_since)
    return sockets.groupBy("uid").agg(F.max(F.when(live, 1).otherwise(0)).alias("online"))


class _Relations(StatefulProcessor):
    """State of a shard: its pairs, each moved by the transition of each of its events."""

    ROWS = "low string, high string, state bigint"

    def __init__(self, table: list[list[int]]):
        self.table = table

    def init(self, handle) -> None:
        self.schema = arrow_schema(self.ROWS)
        self.state = handle.getValueState("shard", "rows binary")

    def handleInputRows(self, key, rows, timerValues):
        held = unpack(self.state.get()[0] if self.state.exists() else None, self.schema)
        new = pd.concat([held, *rows], ignore_index=True)
        new["pair"] = number(new, ["low", "high"])  # pairs held keep their numbers
        pairs = new.drop_duplicates("pair")
        now = pairs["state"].fillna(0).astype(np.int64).tolist()
        events = new.iloc[len(held):].sort_values("seq", kind="stable")
        for pair, kind in zip(events["pair"].tolist(), events["kind"].tolist()):
            now[pair] = self.table[int(kind)][now[pair]]
        self.state.update((pack(pairs[["low", "high"]].assign(state=now), self.schema),))
        yield from ()

    def close(self) -> None:
        pass


def stream_relations(events: DataFrame, root: str, shards: int = SHARDS) -> tuple[StreamingQuery, ShardState]:
    """Invitation states: the events of a batch move their pair in order of ``seq``."""
    state = by_shard(JC.pair_events(events), ["low", "high"], shards).transformWithStateInPandas(_Relations(JC.TABLE), "shard int", "Update", "None")
    return start(state, root), ShardState(events.sparkSession, f"{root}/checkpoint", "shard", _Relations.ROWS)


def stream_subscriptions(events: DataFrame, root: str) -> tuple[StreamingQuery, Output]:
    """Last billing event per account and kind; ``subscription_state`` reads the account rows from it."""
    schema = "entity_id string, kind string, seq bigint, last struct<subscription_id:string,status:string>, n bigint"
    return fold_stream(JR.billing_kind(events), list(JR.BILLING_KEYS), JR.billing_last(), root, schema)


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """File stream over a folder of Parquet files, the oldest first."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)
