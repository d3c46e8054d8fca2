"""Streams with a notion of time running out: sessions left open, grants that expire.

Keys are held by shard in Spark's state store, each shard with one timer on event time, at the first second at which one of its keys runs out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from parlor.plans.skew import rank_in_groups
from parlor.streaming.outputs import Output
from parlor.streaming.shards import SHARDS, arrow_schema, by_shard, number, pack, unpack, whole
from parlor.streaming.streams import start

COOKIE = ["owner_id", "cookie_id"]
GRANT = ["resource_id", "entity_id"]
SESSION = "owner_id string, cookie_id string, sys_id bigint, intime bigint, outtime bigint"
REVOKE = "resource_id string, entity_id string, expiry_time bigint"


def _paired(rows: DataFrame) -> DataFrame:
    """Each sign-in with the row that follows it on its cookie: ``followed`` and that row's ``closed`` time."""
    ranked = rank_in_groups(rows.select(*COOKIE, "sys_id", "intime", "outtime"), COOKIE, "sys_id", "_r")
    following = ranked.select(*COOKIE, (F.col("_r") - 1).alias("_r"), F.col("outtime").alias("closed"), F.lit(True).alias("followed"))
    return ranked.where("intime IS NOT NULL").join(following, [*COOKIE, "_r"], "left").drop("_r", "outtime")


def sessions(login_log: DataFrame) -> DataFrame:
    """Each sign-in with the sign-out that is the next row of its cookie, else none."""
    return _paired(login_log).select(*COOKIE, "sys_id", "intime", F.col("closed").alias("outtime"))


def expired_grants(grants: DataFrame, now_epoch: int) -> DataFrame:
    """Grants whose time passed before their next row came, ``at`` its time, or before now."""
    ranked = rank_in_groups(grants.dropDuplicates([*GRANT, "seq"]).select(*GRANT, "seq", "expiry_time", "at"), GRANT, "seq", "_r")
    following = ranked.select(*GRANT, (F.col("_r") - 1).alias("_r"), F.col("at").alias("until"))
    open_until = F.coalesce("until", F.lit(now_epoch))
    return ranked.join(following, [*GRANT, "_r"], "left").where((F.col("expiry_time") > 0) & (F.col("expiry_time") <= open_until)).select(*GRANT, "expiry_time")


def _timer(second: int) -> int:
    """Just before the second is over, so that a watermark at that very second wakes it."""
    return second * 1000 - 1


class _Timed(StatefulProcessor):
    """State of a shard: rows that may run out, and the second its timer is set to."""

    ROWS: str

    def init(self, handle) -> None:
        self.handle, self.schema = handle, arrow_schema(self.ROWS)
        self.state = handle.getValueState("shard", "rows binary, wake bigint")

    def ends(self, rows: pd.DataFrame) -> pd.Series:
        """The second at which each row runs out, null for never."""
        raise NotImplementedError

    def over(self, rows: pd.DataFrame, out: np.ndarray) -> tuple[pd.DataFrame, pd.DataFrame]:
        """Results of the rows that have run out, and the rows that stay."""
        raise NotImplementedError

    def held(self) -> tuple[pd.DataFrame, int | None]:
        data, wake = self.state.get() if self.state.exists() else (None, None)
        return unpack(data, self.schema), wake

    def keep(self, rows: pd.DataFrame, wake: int | None) -> None:
        first = self.ends(rows).min()
        first = None if pd.isna(first) else int(first)
        if wake is not None and wake != first:
            self.handle.deleteTimer(_timer(wake))
        if first is not None and wake != first:
            self.handle.registerTimer(_timer(first))
        self.state.update((pack(rows, self.schema), first))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        rows, _ = self.held()
        passed = (timerValues.getCurrentWatermarkInMs() // 1000 >= self.ends(rows)).fillna(False).to_numpy(bool)
        done, left = self.over(rows, passed)
        self.keep(left, None)  # the timer that rang goes by itself
        yield done

    def close(self) -> None:
        pass


class _Sessions(_Timed):
    """Rows of a shard: the sign-in of each cookie that waits for its next row."""

    ROWS = "owner_id string, cookie_id string, sys_id bigint, intime bigint"
    NUMBERS = ["sys_id", "intime", "outtime", "at"]

    def __init__(self, silent: int):
        self.silent = silent

    def ends(self, rows):
        return rows["intime"] + self.silent

    def over(self, rows, out):
        return rows[out].assign(outtime=pd.array([pd.NA] * int(out.sum()), "Int64")), rows[~out]

    def handleInputRows(self, key, rows, timerValues):
        held, wake = self.held()
        came = whole([held.assign(outtime=pd.NA, at=held["intime"]), *rows], [*COOKIE, *self.NUMBERS], self.NUMBERS)
        came["cookie"] = number(came, COOKIE)
        came = came.drop_duplicates(["cookie", "sys_id"]).sort_values(["cookie", "sys_id"], ignore_index=True)
        following = came.shift(-1)
        followed, opened = came["cookie"] == following["cookie"], came["intime"].notna()
        # a row that comes after the silence closes nothing, whether or not the timer was first
        closed = following["outtime"].where((following["at"] < self.ends(came)).fillna(False))
        self.keep(came.loc[opened & ~followed, held.columns], wake)
        yield came.assign(outtime=closed).loc[opened & followed, [*held.columns, "outtime"]]


def stream_sessions(logins: DataFrame, root: str, silent_seconds: int = 86_400, delay_seconds: int = 600, shards: int = SHARDS) -> tuple[StreamingQuery, Output]:
    """``logins(owner_id, cookie_id, sys_id, intime, outtime, at)`` to closed sessions.

    A sign-in is closed by the next row of its cookie, or without sign-out once it has been silent for too long, by event time ``at``. Rows may come ``delay_seconds`` late;
    later ones are dropped.
    """
    closed = Output(logins.sparkSession, f"{root}/closed", SESSION)
    timed = logins.withColumn("time", F.timestamp_seconds("at")).withWatermark("time", f"{delay_seconds} seconds")
    state = by_shard(timed, COOKIE, shards).transformWithStateInPandas(_Sessions(silent_seconds), SESSION, "Append", "EventTime")
    return start(state, root, closed.write, "append"), closed


class _Grants(_Timed):
    """Rows of a shard: the last row of each grant, and whether that was revoked."""

    ROWS = "resource_id string, entity_id string, seq bigint, expiry_time bigint, revoked bigint"
    NUMBERS = ["seq", "expiry_time", "at"]

    def ends(self, rows):
        return rows["expiry_time"].where((rows["expiry_time"] != 0) & (rows["revoked"] == 0))

    def over(self, rows, out):
        return rows.loc[out, [*GRANT, "expiry_time"]], rows.assign(revoked=rows["revoked"].mask(out, 1))

    def handleInputRows(self, key, rows, timerValues):
        held, wake = self.held()
        came = whole([held.assign(at=pd.NA), *(frame.assign(revoked=0) for frame in rows)], [*GRANT, *self.NUMBERS, "revoked"], [*self.NUMBERS, "revoked"])
        came["grant"] = number(came, GRANT)
        old = np.arange(len(came)) < len(held)
        least = came["grant"].map(came.loc[old].set_index("grant")["seq"]).fillna(-1)
        came = came[old | (came["seq"] > least)].drop_duplicates(["grant", "seq"]).sort_values(["grant", "seq"], ignore_index=True)
        following = came.shift(-1)
        followed = came["grant"] == following["grant"]
        due = followed & (came["expiry_time"] > 0) & (came["expiry_time"] <= following["at"]) & (came["revoked"] == 0)
        self.keep(came.loc[~followed, held.columns], wake)
        yield came.loc[due, [*GRANT, "expiry_time"]]


def stream_grant_expiry(grants: DataFrame, root: str, delay_seconds: int = 0, shards: int = SHARDS) -> tuple[StreamingQuery, Output]:
    """``grants(resource_id, entity_id, seq, expiry_time, at)``: one revoke per grant once event time passes its expiry.

    A later row on a grant replaces its expiry and may lead to another revoke; a row that came before is ignored.
    """
    revokes = Output(grants.sparkSession, f"{root}/revokes", REVOKE)
    timed = grants.withColumn("time", F.timestamp_seconds("at")).withWatermark("time", f"{delay_seconds} seconds")
    state = by_shard(timed, GRANT, shards).transformWithStateInPandas(_Grants(), REVOKE, "Append", "EventTime")
    return start(state, root, revokes.write, "append"), revokes
