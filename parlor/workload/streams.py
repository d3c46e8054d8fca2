"""Registered streams: a given table comes as a file stream of several micro-batches, runs to its end, and the state is read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlor.operators import contact_changes as JC
from parlor.operators import room_changes as JR
from parlor.session import checkpoint_dir
from parlor.streaming import streams as S
from parlor.streaming import timers as T
from parlor.workload import changes
from parlor.workload.fixtures import Tables


def _root(t: Tables) -> str:
    return f"{checkpoint_dir(t._spark)}/streams/{uuid.uuid4().hex}"


#: Micro-batches that a table comes in, and files of each.
PARTS, FILES = 4, 2
# (application, folder) -> folder of the files
_STAGED: dict[tuple[str, str], str] = {}


def _events(t: Tables) -> DataFrame:
    """All events as a stream, in ranges of their number one after the other."""
    key = (t._spark.sparkContext.applicationId, t._folder)
    if key not in _STAGED:
        path, last = f"{_root(t)}/events", t.events.agg(F.coalesce(F.max("event_id"), F.lit(0)) + 1).scalar()
        for i in range(PARTS):
            own = t.events.where(F.floor(F.col("event_id") * PARTS / last) == i)
            own.repartition(FILES).write.mode("append").parquet(path)
        _STAGED[key] = path
    return S.read_stream(t._spark, _STAGED[key], t.events.schema, FILES).withColumn("ts", F.col("ts").cast("timestamp"))


def _peer(t: Tables, step: int):
    n = t.events.agg((F.max("user_id") + 1)).scalar()
    return F.concat(F.lit("u"), ((F.col("user_id") * step + (F.col("event_id") % 8 if step == 3 else F.lit(0)) + 1) % n).cast("string"))


def _channel(t: Tables) -> DataFrame:
    """The rows of the ``channel`` view, built on the stream."""
    e = F.col("event_id")
    attached = F.when(e % 6 < 3, F.lit("x"))
    author = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    base = _events(t).select(
        e.alias("seq"), author.alias("author_id"), _peer(t, 3).alias("entity_id"), F.concat(F.lit("m"), e.cast("string")).alias("message_id"),
        F.col("event_type").alias("message"), (e + 1700000000).alias("ctime"), attached.alias("attachment"), "ts").where("author_id <> entity_id")
    return S.both_inboxes(base).withColumn("sys_id", F.col("seq"))


def _finish(pair):
    query, store = pair
    S.run(query)
    return store.read()


def _posts(t: Tables) -> DataFrame:
    e = F.col("event_id")
    return _events(t).select(
        e.alias("seq"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("author_id"), _peer(t, 5).alias("entity_id"),
        F.concat(F.lit("p"), F.floor(e / 3).cast("string")).alias("message_id"), F.col("event_type").alias("message"), (e + 1710000000).alias("ctime"), "ts",
    ).where("author_id <> entity_id")


def _unread_events(t: Tables) -> DataFrame:
    """Every message, and an acknowledgement by the inbox owner of each third one."""
    messages = _channel(t)
    kinds = F.explode(F.when(F.col("sys_id") % 3 == 0, F.array(F.lit("message"), F.lit("ack"))).otherwise(F.array(F.lit("message"))))
    return messages.withColumn("kind", kinds).select(
        "kind", "owner_id", "entity_id", F.col("owner_id").alias("uid"), "author_id", "message_id", "sys_id")


def _items(t: Tables) -> DataFrame:
    """Chat items as a stream: the other side's messages."""
    one = F.lit(1).cast("bigint")
    return _channel(t).where("author_id = entity_id").select(
        "owner_id", "entity_id", F.col("owner_id").alias("hub_id"), F.lit("chat").alias("category"), F.lit("personal").alias("area"), "ctime", one.alias("cnt"))


def _sockets(t: Tables) -> DataFrame:
    e = F.col("event_id")
    return _events(t).select(
        F.concat(F.lit("s"), F.col("user_id").cast("string"), F.lit("-"), (e % 3).cast("string")).alias("socket_id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("uid"),
        F.when(F.col("event_type").isin("signup", "view", "click"), F.lit("active")).otherwise(F.lit("closed")).alias("state"), e.alias("seq"), (e + 1700000000).alias("at"))


def _relations(t: Tables) -> DataFrame:
    e, kind = F.col("event_id"), F.col("event_type")
    name = F.when(kind == "signup", "invite").when(kind == "view", "accept").when(kind == "click", "acknowledge").when(kind == "error", "refuse").otherwise("delete")
    return _events(t).select(e.alias("seq"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("actor"),
                             F.concat(F.lit("u"), ((F.col("user_id") + 1 + e % 3) % 150).cast("string")).alias("target"), name.alias("event"))


def _billing(t: Tables) -> DataFrame:
    e, kind = F.col("event_id"), F.col("event_type")
    name = (F.when(kind == "signup", "customer.subscription.created").when(kind == "view", "customer.subscription.updated").when(kind == "purchase", "invoice.paid")
            .when(kind == "error", "invoice.payment_failed").otherwise("customer.subscription.deleted"))
    return _events(t).select(e.alias("seq"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("entity_id"), F.concat(F.lit("sub"), (F.col("user_id") % 40).cast("string")).alias("subscription_id"),
                             name.alias("type"), F.when(e % 11 == 0, F.lit("incomplete_expired")).otherwise(F.lit("active")).alias("status"))


def _logins(t: Tables) -> DataFrame:
    e = F.col("event_id")
    out = F.col("event_type") == "error"
    return _events(t).select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("owner_id"), F.concat(F.lit("k"), F.col("user_id").cast("string"), F.lit("-"), (e % 3).cast("string")).alias("cookie_id"),
        e.alias("sys_id"), F.when(~out, e + 1700000000).alias("intime"), F.when(out, e + 1700000000).alias("outtime"), (e + 1700000000).alias("at"))


def _grants(t: Tables) -> DataFrame:
    """Grants renewed by later rows; event time is the number of the event."""
    e = F.col("event_id")
    return _events(t).select(
        F.concat(F.lit("d"), (e % 700).cast("string")).alias("resource_id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("entity_id"), e.alias("seq"),
        F.when(e % 4 == 0, F.lit(0)).otherwise(1700000000 + e + (e * 37) % 5000).cast("bigint").alias("expiry_time"), (e + 1700000000).alias("at"))


#: Seconds of the registered sessions: few enough that some run out.
SILENT, DELAY = 1800, 600

QUERIES = {
    "stream_messages": lambda t: _finish(S.stream_messages(_posts(t), _root(t))).groupBy("owner_id", "message_id").agg(F.count(F.lit(1)).alias("n_rows")),
    "stream_last_message": lambda t: _finish(S.stream_last_message(_channel(t), _root(t))).select("owner_id", "entity_id", F.col("m.sys_id").alias("ref_sys_id"), "m.message", "m.ctime", "m.is_attachment"),
    "stream_markers": lambda t: _finish(S.stream_markers(_channel(t).withColumn("uid", F.col("author_id")), _root(t))),
    "stream_unread": lambda t: _finish(S.stream_unread(_unread_events(t), _root(t))).where("room_count > 0"),
    "stream_notifications": lambda t: _finish(S.stream_notifications(_items(t), _root(t))),
    "stream_presence": lambda t: S.online_users(_finish(S.stream_presence(_sockets(t), _root(t))), 1700000200),
    "stream_relations": lambda t: JC.state_rows(_finish(S.stream_relations(_relations(t), _root(t)))).join(t.user_dir.select(F.col("id").alias("owner_id")), "owner_id", "left_semi"),
    "stream_subscriptions": lambda t: JR.subscription_state(_finish(S.stream_subscriptions(_billing(t), _root(t)))),
    "stream_sessions": lambda t: _finish(T.stream_sessions(_logins(t), _root(t), SILENT, DELAY)),
    "sessions": lambda t: T.sessions(t.login_log),
    "stream_grant_expiry": lambda t: _finish(T.stream_grant_expiry(_grants(t), _root(t))),
}

_GR = """g AS (SELECT 'd' || CAST(event_id % 700 AS VARCHAR) AS resource_id, 'u' || user_id AS entity_id, event_id AS seq,
  CASE WHEN event_id % 4 = 0 THEN CAST(0 AS BIGINT) ELSE 1700000000 + event_id + event_id * 37 % 5000 END AS expiry_time, 1700000000 + event_id AS came FROM events)"""

_SESSIONS = """SELECT owner_id, cookie_id, sys_id, intime, o AS outtime FROM (SELECT *, lead(outtime) OVER (PARTITION BY owner_id, cookie_id ORDER BY sys_id) AS o FROM login_log) WHERE intime IS NOT NULL"""

ORACLES = {
    "stream_messages": """SELECT owner_id, message_id, CAST(1 AS BIGINT) AS n_rows FROM (SELECT 'u' || user_id AS owner_id, 'p' || event_id // 3 AS message_id FROM events WHERE user_id <> (user_id * 5 + 1) % (SELECT max(user_id) + 1 FROM events)
      UNION SELECT 'u' || (user_id * 5 + 1) % (SELECT max(user_id) + 1 FROM events), 'p' || event_id // 3 FROM events WHERE user_id <> (user_id * 5 + 1) % (SELECT max(user_id) + 1 FROM events))""",
    "stream_last_message": """SELECT owner_id, entity_id, max(sys_id) AS ref_sys_id, left(arg_max(message, sys_id), 100) AS message, max(ctime) AS ctime,
      CASE WHEN max_by(struct_pack(x := attachment), sys_id).x IS NOT NULL THEN 1 ELSE 0 END AS is_attachment FROM channel GROUP BY owner_id, entity_id""",
    "stream_markers": "SELECT owner_id, entity_id, author_id AS uid, max(sys_id) AS ref_sys_id FROM channel GROUP BY ALL",
    "stream_unread": """WITH m AS (SELECT owner_id, entity_id, max(sys_id) AS r FROM channel WHERE sys_id % 3 = 0 GROUP BY ALL)
      SELECT c.owner_id, c.entity_id, count(*) AS room_count FROM channel c JOIN m ON m.owner_id = c.owner_id AND m.entity_id = c.entity_id WHERE c.author_id = c.entity_id AND c.sys_id > m.r GROUP BY ALL""",
    "stream_notifications": "SELECT owner_id, entity_id, owner_id AS hub_id, 'chat' AS category, 'personal' AS area, count(*) AS cnt, max(ctime) AS ctime FROM channel WHERE author_id = entity_id GROUP BY owner_id, entity_id",
    "stream_presence": """SELECT uid, max(CASE WHEN state = 'active' AND last_at >= 1700000200 THEN 1 ELSE 0 END) AS online FROM (SELECT 'u' || user_id AS uid, event_id % 3 AS k,
      CASE WHEN arg_max(event_type, event_id) IN ('signup', 'view', 'click') THEN 'active' ELSE 'closed' END AS state, max(event_id) + 1700000000 AS last_at FROM events GROUP BY user_id, event_id % 3) GROUP BY uid""",
    "stream_relations": changes.ORACLES["invitation_fold"],
    "stream_subscriptions": changes.ORACLES["subscription_fold"],
    "sessions": _SESSIONS,
    "stream_sessions": f"""WITH l AS (SELECT *, lead(outtime) OVER w AS o, lead(coalesce(intime, outtime)) OVER w AS came FROM login_log WINDOW w AS (PARTITION BY owner_id, cookie_id ORDER BY sys_id))
      SELECT owner_id, cookie_id, sys_id, intime, CASE WHEN came < intime + {SILENT} THEN o END AS outtime FROM l
      WHERE intime IS NOT NULL AND (came IS NOT NULL OR intime + {SILENT} <= (SELECT max(coalesce(intime, outtime)) FROM login_log) - {DELAY})""",
    "stream_grant_expiry": f"""WITH {_GR}, l AS (SELECT *, lead(came) OVER (PARTITION BY resource_id, entity_id ORDER BY seq) AS until FROM g)
      SELECT resource_id, entity_id, expiry_time FROM l WHERE expiry_time > 0 AND expiry_time <= coalesce(until, (SELECT max(event_id) + 1700000000 FROM events))""",
}
