"""What large tables are shuffled for, and how often."""

import re

import pytest

from conftest import rows
from parlor.operators import message_changes as JM
from parlor.operators import messaging as M
from parlor.operators import notify as N
from parlor.workload import files


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def shuffled(spark):
    """No join is small enough to be broadcast, as none is at size."""
    name, before = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(name, "-1")
    yield spark
    spark.conf.set(name, before)


def test_counts_are_not_shuffled_for_e_mails(shuffled):
    make = shuffled.createDataFrame
    items = make([("o", "m1", "u1", "o", 5, "personal", "chat", 1), ("o", "m2", "u2", "o", 6, "personal", "chat", 1), ("o", None, "h1", "h1", 7, "share", "media", 3)],
                 "owner_id string, resource_id string, entity_id string, hub_id string, ctime bigint, area string, category string, cnt bigint")
    contact = make([("o", "c1", None, None, None, "active", 1, "u1", "u1"), ("o", "c2", None, None, None, "active", 2, "u1", "u1"), (None, "c3", None, None, None, "active", 3, "u2", "u2")],
                   "owner_id string, id string, firstname string, lastname string, surname string, status string, sys_id bigint, uid string, entity string")
    mail = make([("o", "c1", "one@x", 1, 1), ("o", "c2", "two@x", 1, 2), (None, "c3", "no@x", 1, 3)], "owner_id string, contact_id string, email string, is_default int, sys_id bigint")
    people = make([("u2", "dir@x", "A", "B")], "id string, email string, firstname string, lastname string")
    got = N.notification_center(items, contact, mail, people, make([("h1", "room")], "id string, name string"),
                                make([("t", "c1", "o")], "tag_id string, id string, owner_id string"), make([("t",)], "tag_id string"))
    assert rows(got, "key_id", "email", "surname", "tag_id", "cnt") == [("c1", "one@x", "one@x", "t", 1), ("h1", None, "room", None, 3), ("u2", "dir@x", "dir@x", None, 1)]
    assert len(re.findall(r"hashpartitioning\(owner_id#\d+, contact_id#", _plan(got))) == 1  # that of the e-mails alone


def test_room_list_takes_only_the_messages_of_listed_rooms(shuffled):
    make = shuffled.createDataFrame
    talk = make([("h1", 1, "u1", "a", 10, None), ("h1", 2, "u2", "b", 11, None), ("h2", 3, "u2", "c", 12, None)], "hub_id string, sys_id bigint, author_id string, message string, ctime bigint, attachment string")
    read = make([("h1", "u1", 1), ("h2", "u1", 0)], "hub_id string, uid string, ref_sys_id bigint")
    gone = make([("h1", "u1", 2), ("h2", "u1", 3)], "hub_id string, uid string, ref_sys_id bigint")
    rooms = make([("u1", "h1", "one", "private"), ("u1", "h2", "two", "share")], "owner_id string, hub_id string, name string, area string")
    none = lambda schema: make([], schema)
    got = M.chat_rooms(
        none("owner_id string"), none("owner_id string"), none("id string"), none("uid string, state string"), none("owner_id string"), none("owner_id string, entity_id string"),
        none("owner_id string, entity_id string, sys_id bigint, message string, ctime bigint, attachment string, metadata string, author_id string"),
        none("owner_id string, entity_id string, uid string, ref_sys_id bigint"), rooms, talk, read, gone, flag="share")
    assert rows(got, "owner_id", "entity_id", "room_count", "message") == [("u1", "h1", 1, "a")]
    assert _plan(got).count("LeftSemi") >= 3


def test_cards_are_exported_once(spark, monkeypatch):
    class Held:
        user_dir = spark.createDataFrame([("u2", "a.b@x")], "id string, email string")
        contact = spark.createDataFrame([("u9", "u9")], "owner_id string, entity string")

    kept = []
    text = "BEGIN:VCARD\nEMAIL:a.b@x\nTEL:tel:12\nEND:VCARD\n"
    monkeypatch.setattr(files, "_cards", lambda t: spark.createDataFrame([("u1", "a.b@x", text)], "owner_id string, email string, vcard string"))
    real = files.written
    monkeypatch.setattr(files, "written", lambda df: kept.append(df) or real(df))
    got = files.QUERIES["import_vcard_phones"](Held)
    assert len(kept) == 1 and "BEGIN:VCARD" not in _plan(got)
    assert rows(got, "owner_id", "phone", "is_default", "category") == [("u2", "12", 1, "prof")]


def _shuffled_rows(df) -> int:
    """Rows written by all shuffles of a run of ``df``."""
    df.collect()

    def walk(node) -> int:
        kind = node.nodeName()
        if kind == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if kind.endswith("QueryStage"):
            return walk(node.plan())
        if kind == "ReusedExchange":
            return 0
        own = node.metrics().get("shuffleRecordsWritten").get().value() if kind == "Exchange" else 0
        return own + sum(walk(node.children().apply(i)) for i in range(node.children().size()))

    return walk(df._jdf.queryExecution().executedPlan())


def _talk(spark):
    """300 messages and 3,000 markers in 10 rooms."""
    talk = [(f"h{k % 10}", k, f"u{k % 7}", 100 + k) for k in range(300)]
    read = [(f"h{r}", f"u{m}", (m * 31 + r) % 320 - 5) for r in range(10) for m in range(300)]
    return talk, read, spark.createDataFrame(talk, "hub_id string, sys_id bigint, author_id string, ctime bigint"), spark.createDataFrame(read, "hub_id string, uid string, ref_sys_id bigint")


def test_markers_are_shuffled_once_to_be_counted(shuffled):
    talk, read, channel, marks = _talk(shuffled)
    got = M.unread_team(channel, marks)
    assert _shuffled_rows(got) < 1.5 * (len(talk) + len(read))
    assert rows(got) == sorted(((h, u, sum(1 for t in talk if t[0] == h and t[1] > at and t[2] != u)) for h, u, at in read), key=repr)


def test_pending_messages_take_one_shuffle_of_the_markers(shuffled):
    talk, read, channel, marks = _talk(shuffled)
    got = N.team_pending(channel, marks)
    assert _shuffled_rows(got) < 1.5 * (len(talk) + len(read))
    want = [(h, u, n, 100 + max(t[1] for t in talk if t[0] == h)) for h, u, at in read if (n := sum(1 for t in talk if t[0] == h and t[1] > at))]
    assert rows(got) == sorted(want, key=repr)


def test_cleared_rooms_are_made_distinct_where_they_lie(shuffled):
    desk = [(f"u{m}", f"h{r}", "share") for r in range(10) for m in range(300)]
    media = shuffled.createDataFrame([(f"h{r}", 10 + r) for r in range(10)] + [("h3", 99)], "hub_id string, sys_id bigint")
    rooms = shuffled.createDataFrame(desk, "owner_id string, hub_id string, area string")
    users = shuffled.createDataFrame([(f"u{m}",) for m in range(300)], "uid string")
    got = JM.clear_file_markers(users, rooms, media)
    assert _shuffled_rows(got) < 2.5 * len(desk)
    assert rows(got) == sorted(((f"h{r}", f"u{m}", 99 if r == 3 else 10 + r) for r in range(10) for m in range(300)), key=repr)
