"""Tickets of the support team in the notification feed: a row for each that a member never opened."""

import __spark_entry__ as entry
from conftest import rows
from parlor.operators import notify as N
from parlor.workload.fixtures import Tables

FOLDER = "/root/testdata/sf0.001"


def test_every_ticket_of_the_team_is_listed(spark):
    t = Tables(spark, FOLDER)
    team = {r["id"] for r in t.user_dir.where("domain_id = 0").collect()}
    marks = {(r["uid"], r["ticket_id"]) for r in t.read_ticket_channel.collect()}
    want = sorted((o, str(k["ticket_id"])) for o in team for k in t.ticket.where("last_sys_id > 0").collect() if (o, k["ticket_id"]) not in marks)
    got = entry.queries()["notification_center"](spark, FOLDER).where("category = 'ticket' AND ctime IS NULL")
    assert [r for r in rows(got, "owner_id", "surname") if r[0] in team] == want and want


def test_listed_tickets_are_those_of_the_pairs(spark, monkeypatch):
    """With members and tickets that come twice, markers without a ticket, and tickets that are contacts, users or tagged."""
    monkeypatch.setattr(N, "TEAM_BLOCK", 3)
    make = spark.createDataFrame
    team = [f"u{k}" for k in range(20)] + ["u3", None]
    people = make([(k, f"{k}@x", "A", "B", 0) for k in team] + [("12", "12@x", "T", "Twelve", 1), ("u90", "c@x", "C", "D", 1)], "id string, email string, firstname string, lastname string, domain_id int")
    ticket = make([(k, "u90", 5) for k in range(10, 17)] + [(11, "u90", 6), (99, "u90", 0)], "ticket_id bigint, uid string, last_sys_id bigint")
    read = make([(k, f"u{m}", 4 + m % 2, 100) for k in (10, 12, 77) for m in range(0, 20, 3)] + [(10, None, 1, 5), (13, "u3", 1, 9), (13, "u3", 2, 8)], "ticket_id bigint, uid string, ref_sys_id bigint, ctime bigint")
    contact = make([("u1", "c1", "F", None, None, "active", 1, None, "14"), ("u3", "c2", None, None, "S", "sent", 2, "11", "u90"), ("u90", "c3", "G", None, None, "sent", 3, "11", None)],
                   "owner_id string, id string, firstname string, lastname string, surname string, status string, sys_id bigint, uid string, entity string")
    mail = make([("u1", "c1", "one@y", 1, 1)], "owner_id string, contact_id string, email string, is_default int, sys_id bigint")
    marked = make([("g", "15", "u2"), ("g", "12", "u4"), ("g", "c1", "u1"), ("h", "15", "u2"), ("g", "16", "u90")], "tag_id string, id string, owner_id string")
    tags = make([("g",), ("h",)], "tag_id string")
    hub = make([("h1", "room")], "id string, name string")
    items = N.ticket_items(ticket, read, people, 0, unmarked=False).selectExpr(
        "owner_id", "entity_id AS resource_id", "entity_id", "'Support Ticket' AS hub_id", "ctime", "'personal' AS area", "'ticket' AS category", "cnt")
    held = {(r["ticket_id"], r["uid"]) for r in read.collect()}
    pairs = make([(o, str(k["ticket_id"]), str(k["ticket_id"]), N.TICKETS, None, "personal", "ticket", 1) for o in team for k in ticket.where("last_sys_id > 0").collect() if o is None or (k["ticket_id"], o) not in held], items.schema)
    want = N.notification_center(items.unionByName(pairs), contact, mail, people, hub, marked, tags)
    got = N.notification_center(items, contact, mail, people, hub, marked, tags, N.unmarked_tickets(ticket, read, people))
    assert rows(got, *want.columns) == rows(want) and got.count() > 100
