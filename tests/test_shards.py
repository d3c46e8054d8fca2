"""Processor streams hold many keys to a shard: as many rows of state as shards, whatever the keys, and the results of the batch twins."""

import random

from pyspark.sql import functions as F

from conftest import rows
from parlor.operators import contact_changes as JC
from parlor.operators import messaging as M
from parlor.streaming import streams as S
from parlor.streaming import timers as T
from parlor.streaming.outputs import State
from test_streams import feed


def test_grants_of_a_shard(spark, tmp_path):
    rnd = random.Random(5)
    data = []
    for n in range(400):
        at = 1000 + n
        data.append((rnd.choice(["d1", "d2", "d3", "d4", None]), rnd.choice([f"u{i}" for i in range(9)] + [None]), n, rnd.choice([0, at + rnd.randrange(1, 120)]), at, n // 100))
    data += [(*row[:5], 3) for row in data[-5:]]
    clean, stream = feed(spark, tmp_path / "in", data, "resource_id string, entity_id string, seq bigint, expiry_time bigint, at bigint, part int")
    query, revokes = T.stream_grant_expiry(stream, str(tmp_path / "out"), shards=3)
    query.awaitTermination()
    full = clean.where("resource_id IS NOT NULL AND entity_id IS NOT NULL")
    got = revokes.read()
    assert rows(got.where("resource_id IS NOT NULL AND entity_id IS NOT NULL")) == rows(T.expired_grants(full, 1399))
    named = clean.fillna("?", ["resource_id", "entity_id"])
    assert rows(got.fillna("?")) == rows(T.expired_grants(named, 1399))
    assert State(spark, str(tmp_path / "out" / "checkpoint"), "shard").read().count() == 3


def test_sessions_of_a_shard(spark, tmp_path):
    rnd = random.Random(6)
    data = []
    for n in range(400):
        at, out = 1000 + n, rnd.random() < 0.3
        data.append((rnd.choice(["o", "p", None]), f"k{rnd.randrange(12)}", n, None if out else at, at if out else None, at, n // 100))
    clean, stream = feed(spark, tmp_path / "in", data, "owner_id string, cookie_id string, sys_id bigint, intime bigint, outtime bigint, at bigint, part int")
    query, closed = T.stream_sessions(stream, str(tmp_path / "out"), 60, 0, shards=3)
    query.awaitTermination()
    named = clean.fillna("?", ["owner_id"])
    came = named.select("owner_id", "cookie_id", (F.col("sys_id")).alias("sys_id"), "intime", F.col("at").alias("outtime"))
    paired = T.sessions(named).join(T.sessions(came).select("owner_id", "cookie_id", "sys_id", F.col("outtime").alias("came")), ["owner_id", "cookie_id", "sys_id"])
    want = paired.where("came IS NOT NULL OR intime + 60 <= 1399").select("owner_id", "cookie_id", "sys_id", "intime", F.when(F.col("came") < F.col("intime") + 60, F.col("outtime")).alias("outtime"))
    assert rows(closed.read().fillna("?", ["owner_id"])) == rows(want)
    assert State(spark, str(tmp_path / "out" / "checkpoint"), "shard").read().count() == 3


def test_inboxes_of_a_shard(spark, tmp_path):
    """Markers that cross blocks, before and after their messages; an inbox without a marker; repeated rows."""
    rnd = random.Random(7)
    data = []
    for n in range(400):
        owner, entity = rnd.sample([f"u{i}" for i in range(9)], 2)
        place = n * S._Unread.WIDTH // 90
        data.append(("message", owner, entity, owner, rnd.choice([owner, entity]), f"m{n}", place, n // 100))
        if n % 5 == 0:
            data.append(("ack", owner, entity, rnd.choice([owner, owner, entity]), owner, f"m{n}", place, rnd.randrange(4)))
        if n % 9 == 0:
            data.append((*data[-1][:7], 3))
    clean, stream = feed(spark, tmp_path / "in", data, S.EVENT + ", part int")
    query, counts = S.stream_unread(stream, str(tmp_path / "out"), shards=3)
    query.awaitTermination()
    marks = clean.where("kind = 'ack'").groupBy("owner_id", "entity_id", "uid").agg(F.max("sys_id").alias("ref_sys_id"))
    want = M.unread_direct(clean.where("kind = 'message'").dropDuplicates(["owner_id", "message_id"]), marks)
    assert rows(counts.read().where("room_count > 0"), "owner_id", "entity_id", "room_count") == rows(want)
    assert State(spark, str(tmp_path / "out" / "checkpoint"), "shard").read().count() == 3


def test_pairs_of_a_shard(spark, tmp_path):
    rnd = random.Random(8)
    data = [(n, *rnd.sample([f"u{i}" for i in range(9)], 2), rnd.choice(JC.EVENTS), n // 100) for n in range(400)]
    clean, stream = feed(spark, tmp_path / "in", data, "seq bigint, actor string, target string, event string, part int")
    query, pairs = S.stream_relations(stream, str(tmp_path / "out"), shards=3)
    query.awaitTermination()
    assert rows(JC.state_rows(pairs.read()), "owner_id", "entity", "status") == rows(JC.invitation_fold(clean), "owner_id", "entity", "status")
    assert State(spark, str(tmp_path / "out" / "checkpoint"), "shard").read().count() == 3
