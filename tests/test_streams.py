"""Streams fed file by file end where their batch twins end; repeated batches change nothing."""

import random

from pyspark.sql import functions as F

from conftest import rows
from parlor.operators import contact_changes as JC
from parlor.operators import messaging as M
from parlor.streaming import streams as S
from parlor.streaming import timers as T
from parlor.streaming.outputs import Output


def feed(spark, folder, data, schema, parts=4):
    df = spark.createDataFrame(data, schema)
    for i in range(parts):
        df.where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(str(folder))
    clean = df.drop("part")
    return clean, spark.readStream.schema(clean.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_output_repeats_a_batch(spark, tmp_path):
    out = Output(spark, str(tmp_path / "s"), "k string, v int", ["k"])
    assert out.read().count() == 0
    for n, data in enumerate([[("a", 1), ("b", 1)], [("a", 2)], [("c", 3)], [("b", 9)], [("a", 7)]]):
        for _ in range(2):
            out.write(spark.createDataFrame(data, "k string, v int"), n)
    assert rows(out.read()) == [("a", 7), ("b", 9), ("c", 3)]
    every = Output(spark, str(tmp_path / "t"), "k string")
    for n in (0, 1, 1):
        every.write(spark.createDataFrame([("x",)], "k string"), n)
    assert rows(every.read()) == [("x",), ("x",)]


def test_unread_goes_on_after_a_restart(spark, tmp_path):
    """Positions in several blocks; a marker that cuts a block; messages below the marker; repeated rows."""
    w = S._Unread.WIDTH
    message = lambda n, by="b": ("message", "a", "b", "a", by, f"m{n}", n)
    steps = [([message(n) for n in (1, 2, w, w + 1, 3 * w, 3 * w + 5)] + [message(7, "a")], None), ([("ack", "a", "b", "a", "a", "m", w)], 3), ([message(w + 1), message(3), message(5 * w)], 4),
             ([("ack", "a", "b", "b", "b", "m", 9 * w), ("ack", "a", "b", "a", "a", "m", 2)], 4), ([("ack", "a", "b", "a", "a", "m", 3 * w)], 2), ([("ack", "a", "b", "a", "a", "m", 9 * w)], 0)]
    for data, want in steps:
        spark.createDataFrame(data, S.EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query, counts = S.stream_unread(spark.readStream.schema(S.EVENT).parquet(str(tmp_path / "in")), str(tmp_path / "out"))
        S.run(query)
        assert [r["room_count"] for r in counts.read().collect()] == ([] if want is None else [want])


def test_unread_with_early_acks(spark, tmp_path):
    rnd = random.Random(11)
    data = []
    for i in range(300):
        owner, entity = rnd.sample(["a", "b", "c"], 2)
        part = rnd.randrange(4)
        data.append(("message", owner, entity, owner, rnd.choice([owner, entity]), f"m{i}", i, part))
        if i % 7 == 0:
            data.append(("ack", owner, entity, owner, owner, f"m{i}", i, rnd.randrange(4)))
        if i % 10 == 0:
            data.append(data[-1][:7] + (3,))
    clean, stream = feed(spark, tmp_path / "in", data, S.EVENT + ", part int")
    query, counts = S.stream_unread(stream, str(tmp_path / "out"))
    S.run(query)
    marks = clean.where("kind = 'ack'").groupBy("owner_id", "entity_id", "uid").agg(F.max("sys_id").alias("ref_sys_id"))
    want = M.unread_direct(clean.where("kind = 'message'").dropDuplicates(["owner_id", "message_id"]), marks)
    assert rows(counts.read().where("room_count > 0"), "owner_id", "entity_id", "room_count") == rows(want)


def test_messages_once_per_inbox(spark, tmp_path):
    data = [(i, f"2024-01-0{1 + i % 4} 00:00:00", f"u{i % 3}", f"v{i % 2}", f"m{i % 20}", "x", 100 + i, i % 4) for i in range(80)]
    _, stream = feed(spark, tmp_path / "in", data, "seq bigint, ts string, author_id string, entity_id string, message_id string, message string, ctime bigint, part int")
    query, store = S.stream_messages(stream.withColumn("ts", F.to_timestamp("ts")), str(tmp_path / "out"))
    S.run(query)
    got = rows(store.read(), "owner_id", "message_id")
    want = {(o, d[4]) for d in data for o in (d[2], d[3])}
    assert len(got) == len(want) and set(got) == want


def test_relations(spark, tmp_path):
    rnd = random.Random(3)
    data = []
    for i in range(200):
        a, b = rnd.sample(["a", "b", "c"], 2)
        data.append((i, a, b, rnd.choice(JC.EVENTS), i // 50))
    clean, stream = feed(spark, tmp_path / "in", data, "seq bigint, actor string, target string, event string, part int")
    query, store = S.stream_relations(stream, str(tmp_path / "out"))
    S.run(query)
    assert rows(JC.state_rows(store.read()), "owner_id", "entity", "status") == rows(JC.invitation_fold(clean), "owner_id", "entity", "status")


def test_sessions_across_batches(spark, tmp_path):
    base = 1_700_000_000
    data = [("o", "k1", 1, base, None, base, 0), ("o", "k1", 2, None, base + 50, base + 50, 1), ("o", "k2", 3, base + 60, None, base + 60, 1),
            ("o", "k2", 4, base + 70, None, base + 70, 2), ("o", "k2", 5, None, base + 80, base + 80, 3), ("o", "k3", 6, base + 90, None, base + 90, 2),
            ("p", "k4", 7, None, base + 90000, base + 90000, 3)]
    clean, stream = feed(spark, tmp_path / "in", data, "owner_id string, cookie_id string, sys_id bigint, intime bigint, outtime bigint, at bigint, part int")
    query, closed = T.stream_sessions(stream, str(tmp_path / "out"), 3600, 0)
    S.run(query)
    assert rows(closed.read()) == rows(T.sessions(clean))


def test_a_row_after_the_silence_closes_nothing(spark, tmp_path):
    """The same in one batch as in two."""
    data = [("o", "k", 1, 100, None, 100, 0), ("o", "k", 2, None, 900, 900, 1), ("o", "j", 3, 110, None, 110, 0), ("o", "j", 4, None, 950, 950, 0), ("o", "i", 5, 905, None, 905, 1), ("o", "i", 6, None, 960, 960, 1)]
    _, stream = feed(spark, tmp_path / "in", data, "owner_id string, cookie_id string, sys_id bigint, intime bigint, outtime bigint, at bigint, part int", 2)
    query, closed = T.stream_sessions(stream, str(tmp_path / "out"), 500, 0)
    S.run(query)
    assert rows(closed.read(), "sys_id", "outtime") == [(1, None), (3, None), (5, 960)]


def test_open_session_waits(spark, tmp_path):
    _, stream = feed(spark, tmp_path / "in", [("o", "k", 1, 100, None, 100, 0)], "owner_id string, cookie_id string, sys_id bigint, intime bigint, outtime bigint, at bigint, part int", 1)
    query, closed = T.stream_sessions(stream, str(tmp_path / "out"), 3600, 0)
    S.run(query)
    assert closed.read().count() == 0


def test_grants_expire_once(spark, tmp_path):
    data = [("d1", "u", 1, 150, 100, 0), ("d2", "u", 2, 500, 110, 0), ("d3", "u", 3, 0, 120, 0), ("d2", "u", 4, 180, 130, 1), ("d1", "u", 1, 150, 100, 2), ("d9", "u", 5, 0, 200, 2), ("d9", "u", 6, 0, 300, 3)]
    clean, stream = feed(spark, tmp_path / "in", data, "resource_id string, entity_id string, seq bigint, expiry_time bigint, at bigint, part int")
    query, revokes = T.stream_grant_expiry(stream, str(tmp_path / "out"))
    S.run(query)
    assert rows(revokes.read()) == [("d1", "u", 150), ("d2", "u", 180)] == rows(T.expired_grants(clean, 300))


def test_a_grant_that_ran_out_before_it_was_renewed(spark, tmp_path):
    data = [("d", "u", 1, 150, 100, 0), ("d", "u", 2, 400, 200, 1), ("e", "u", 3, 0, 160, 0), ("f", "u", 4, 0, 500, 2), ("g", "u", 5, 160, 155, 0), ("g", "u", 6, 0, 156, 1)]
    clean, stream = feed(spark, tmp_path / "in", data, "resource_id string, entity_id string, seq bigint, expiry_time bigint, at bigint, part int", 3)
    query, revokes = T.stream_grant_expiry(stream, str(tmp_path / "out"), 10)
    S.run(query)
    assert rows(revokes.read()) == [("d", "u", 150), ("d", "u", 400)] == rows(T.expired_grants(clean, 490))


def test_a_late_message_reaches_the_inbox(spark, tmp_path):
    at = lambda d, h=0: __import__("datetime").datetime(2024, 1, d, h)
    data = [(1, at(9), "a", "b", "m1", "x", 1, 0), (2, at(9, 5), "a", "b", "m2", "x", 2, 1), (3, at(1), "a", "b", "late", "x", 3, 2), (4, at(9), "a", "b", "m1", "x", 1, 3), (5, at(2), "a", "b", "late", "x", 3, 3)]
    clean, stream = feed(spark, tmp_path / "in", data, "seq bigint, ts timestamp, author_id string, entity_id string, message_id string, message string, ctime bigint, part int")
    query, store = S.stream_messages(stream, str(tmp_path / "out"))
    S.run(query)
    assert rows(store.read(), "owner_id", "message_id", "sys_id") == [(o, m, n) for o in "ab" for m, n in (("late", 3), ("m1", 1), ("m2", 2))]
