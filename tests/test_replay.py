"""Change sets applied twice change nothing the second time; invariants of the results."""

from conftest import rows
from parlor.operators import changes as J
from parlor.operators import contact_changes as JC
from parlor.operators import grants as G
from parlor.operators import message_changes as JM
from parlor.operators import room_changes as JR
from parlor.workload import changes as W
from parlor.workload import registry
from parlor.workload.fixtures import Tables

FOLDER = "/root/testdata/sf0.001"


def test_upsert_and_index(spark):
    t = Tables(spark, FOLDER)
    once = J.upsert(t.sql(W.OLD_BLACK), t.sql(W.BLACK), ["owner_id", "email"])
    assert rows(J.upsert(once, t.sql(W.BLACK), ["owner_id", "email"]), "owner_id", "email", "sys_id") == rows(once, "owner_id", "email", "sys_id")
    pages = JR.index_upsert(t.sql(W.PAGES), t.sql(W.PAGE_CHANGES))
    assert rows(JR.index_upsert(pages, t.sql(W.PAGE_CHANGES)), "key", "content") == rows(pages, "key", "content")


def test_posts(spark):
    t = Tables(spark, FOLDER)
    new = JM.post_messages(t.sql(W.POSTS), t.channel)
    both = t.channel.select("owner_id", "message_id", "sys_id").unionByName(new.select("owner_id", "message_id", "sys_id"))
    assert new.count() and JM.post_messages(t.sql(W.POSTS), both).count() == 0


def test_acks(spark):
    t = Tables(spark, FOLDER)
    cols = ["owner_id", "entity_id", "uid", "ref_sys_id"]
    once = JM.apply_acks(t.sql(W.ACKS), t.channel, t.read_channel)
    assert rows(JM.apply_acks(t.sql(W.ACKS), t.channel, once), *cols) == rows(once, *cols)
    before = {r[:3]: r[3] for r in rows(t.read_channel, *cols)}
    after = {r[:3]: r[3] for r in rows(once, *cols)}
    assert all(after[k] >= v for k, v in before.items())


def test_deletes(spark):
    t = Tables(spark, FOLDER)
    once = JM.apply_deletes(t.sql(W.DELS), t.channel)
    assert rows(JM.apply_deletes(t.sql(W.DELS), once), "owner_id", "message_id") == rows(once, "owner_id", "message_id")


def test_grants_never_orphan_a_room(spark):
    t = Tables(spark, FOLDER)
    cols = ["hub_id", "resource_id", "entity_id", "permission", "expiry_time", "assign_via"]
    old = t.sql(W.GRANTS)
    once = JR.apply_grants(old, t.sql(W.GRANT_CHANGES), W.NOW)
    assert rows(JR.apply_grants(once, t.sql(W.GRANT_CHANGES), W.NOW), *cols) == rows(once, *cols)
    rooms = old.select("hub_id")
    assert rows(G.orphan_rooms(rooms, once)) == rows(G.orphan_rooms(rooms, old))


def test_membership_and_sync(spark):
    t = Tables(spark, FOLDER)
    once = JR.membership(t.hub_member, t.sql(W.MOVES))
    assert rows(JR.membership(once, t.sql(W.MOVES))) == rows(once)
    synced = JC.contact_sync(t.contact_sync, t.user_dir, t.contact, t.contact_email, t.contact_phone, t.contact_address)
    again = JC.contact_sync(synced["sync"], t.user_dir, synced["contact"], synced["email"], synced["phone"], synced["address"])
    for name in ("contact", "email", "phone", "address"):
        assert rows(again[name]) == rows(synced[name])


def test_dashboard_adds_up(spark):
    for r in registry.queries()["unread_dashboard"](Tables(spark, FOLDER)).collect():
        assert r.total_cnt == r.share_chat_cnt + r.contact_chat_cnt + r.archive_chat_cnt + r.support_cnt
