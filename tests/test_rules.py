"""Rules with branches: hand-made rows with the expected rows typed in, and brute force."""

import random

from pyspark.sql import functions as F

from conftest import rows
from parlor.functions import expr as X
from parlor.operators import contact_changes as JC
from parlor.operators import grants as G
from parlor.operators import message_changes as JM
from parlor.operators import room_changes as JR
from parlor.operators import messaging as M
from parlor.operators import notify as N
from parlor.operators import pages as P
from parlor.operators import search as S
from parlor.operators import trees
from parlor.operators.grants import effective_grant, nearest_grant
from parlor.plans import forest
from parlor.sources import imports as I


def test_display_name(spark):
    df = spark.createDataFrame([
        (1, "Sur", "F", "L", "m@a", "d@a"), (2, None, "F", None, "m@a", "d@a"), (3, None, None, "L", "m@a", "d@a"),
        (4, None, None, None, "m@a", "d@a"), (5, None, None, None, None, "d@a"), (6, None, None, None, None, None)],
        "i int, s string, f string, l string, m string, d string")
    assert [r[1] for r in rows(df.select("i", X.display_name("s", "f", "l", "m", "d")))] == ["Sur", "F ", " L", "m@a", "d@a", None]


def test_prefix_ignores_case_and_accents(spark):
    df = spark.createDataFrame([("Élodie",), ("elan",), ("Melo",), (None,)], "n string")
    assert rows(df.where(X.any_starts_with(["n"], " EL "))) == [("elan",), ("Élodie",)]
    assert df.where(X.any_starts_with(["n"], "0")).count() == 4


def test_is_new(spark):
    df = spark.createDataFrame([
        (1, '{"_seen_":{"u2":1}}', "u1"), (2, '{"_seen_":{"u9":1}}', "u1"), (3, '{"_seen_":{}}', "u1"), (4, "{}", "u1"), (5, None, "u1"),
        (6, '{"_seen_":{"u2":1}}', "u9"), (7, "not json", "u1")], "i int, m string, o string")
    assert [r[1] for r in rows(df.select("i", X.is_new("m", "o", F.lit("u9"))))] == [1, 0, 1, 0, 0, 0, 0]


def test_cleared_files_are_not_new(spark):
    media = spark.createDataFrame(
        [("h", s, "u1", "/f", "doc", 10 * s, '{"_seen_":{"u3":1}}' if s % 2 else '{"_seen_":{}}') for s in range(1, 6)],
        "hub_id string, sys_id bigint, owner_id string, file_path string, category string, upload_time bigint, metadata string")
    members = spark.createDataFrame([("h", u) for u in ("u1", "u2", "u3", "u4")], "hub_id string, uid string")
    rooms, who = members.select("hub_id", F.col("uid").alias("owner_id"), F.lit("private").alias("area")), members.where("uid IN ('u2', 'u3')").select("uid")
    assert rows(N.new_files(media, members, JM.clear_file_markers(who, rooms, media))) == [("h", "u4", 5, 50)]
    early = JM.clear_file_markers(who, rooms, media.where("sys_id <= 3"))
    assert rows(N.new_files(media, members, early)) == [("h", "u2", 2, 50), ("h", "u3", 1, 40), ("h", "u4", 5, 50)]
    marked = media.join(early.where("uid = 'u2'"), "hub_id").select("sys_id", X.is_new("metadata", "owner_id", "uid", "sys_id", "seen_upto").alias("n"))
    assert rows(marked) == [(1, 0), (2, 0), (3, 0), (4, 1), (5, 1)]


def test_calendar(spark):
    df = spark.createDataFrame([(1, 1704067199), (2, 1704067200), (3, 1706745600), (4, 1735689600)], "i int, t bigint")
    assert rows(df.where(X.in_calendar("t", year=2024)), "i") == [(2,), (3,)]
    assert rows(df.where(X.in_calendar("t", month=1, year=2024)), "i") == [(2,)]
    assert rows(df.where(X.in_calendar("t", start=1704067200, end=1706745600)), "i") == [(2,), (3,)]


def test_unread_keeps_tenants_apart(spark):
    channel = spark.createDataFrame([("a", "x", "x", 1), ("a", "x", "x", 5), ("b", "x", "x", 1), ("b", "x", "b", 9)], "owner_id string, entity_id string, author_id string, sys_id bigint")
    marks = spark.createDataFrame([("a", "x", "a", 1), ("a", "x", "x", 99), ("b", "x", "b", 0)], "owner_id string, entity_id string, uid string, ref_sys_id bigint")
    assert rows(M.unread_direct(channel, marks)) == [("a", "x", 1), ("b", "x", 1)]


def test_team_unread_counts_others_only(spark):
    channel = spark.createDataFrame([("h", s, a) for s, a in ((1, "u"), (2, "v"), (3, "u"), (4, "w"))], "hub_id string, sys_id bigint, author_id string")
    marks = spark.createDataFrame([("h", "u", 0), ("h", "v", 2), ("h", "w", 9), ("k", "u", 3)], "hub_id string, uid string, ref_sys_id bigint")
    assert rows(M.unread_team(channel, marks)) == [("h", "u", 2), ("h", "v", 2), ("h", "w", 0), ("k", "u", 0)]


def test_newest_unread_team(spark):
    channel = spark.createDataFrame([("h", 1, "u", 10), ("h", 2, "v", 20), ("h", 3, "u", 30), ("k", 1, "u", 5)], "hub_id string, sys_id bigint, author_id string, ctime bigint")
    marks = spark.createDataFrame([("h", "u", 0), ("h", "v", 1), ("h", "w", 3), ("k", "u", 0)], "hub_id string, uid string, ref_sys_id bigint")
    assert rows(M.newest_unread_team(channel, marks)) == [("h", "u", 2, 20), ("h", "v", 3, 30)]


def test_invitation_table(spark):
    steps = [
        ([("a", "b", "invite")], {("a", "b"): "sent", ("b", "a"): "received"}),
        ([("a", "b", "invite"), ("b", "a", "accept")], {("a", "b"): "informed", ("b", "a"): "active"}),
        ([("a", "b", "invite"), ("b", "a", "accept"), ("a", "b", "acknowledge")], {("a", "b"): "active", ("b", "a"): "active"}),
        ([("a", "b", "invite"), ("b", "a", "refuse")], {("a", "b"): "sent"}),
        ([("a", "b", "invite"), ("b", "a", "invite")], {("a", "b"): "informed", ("b", "a"): "active"}),
        ([("a", "b", "invite"), ("b", "a", "accept"), ("b", "a", "delete")], {("a", "b"): "memory"}),
        ([("a", "b", "invite"), ("a", "b", "delete")], {}),
        ([("a", "b", "delete")], {}),
    ]
    data, want = [], []
    for n, (events, state) in enumerate(steps):
        data += [(n * 10 + i, f"{a}{n}", f"{t}{n}", e) for i, (a, t, e) in enumerate(events)]
        want += [(f"{a}{n}", f"{t}{n}", s) for (a, t), s in state.items()]
    got = JC.invitation_fold(spark.createDataFrame(data, "seq bigint, actor string, target string, event string"))
    assert rows(got, "owner_id", "entity", "status") == sorted(want, key=repr)


def test_invitation_fold_in_chunks(spark):
    rnd = random.Random(5)
    data, state = [], {}
    for seq in range(300):
        a, b = rnd.sample(["a", "b"] if seq % 2 else ["a", "b", "c", "d"], 2)
        event = rnd.choice(JC.EVENTS)
        data.append((seq, a, b, event))
        mine, his = JC.step(event, state.get((a, b), "none"), state.get((b, a), "none"))
        state[a, b], state[b, a] = mine, his
    want = sorted(((a, b, s) for (a, b), s in state.items() if s != "none"), key=repr)
    got = JC.invitation_fold(spark.createDataFrame(data, "seq bigint, actor string, target string, event string"), chunk=3)
    assert rows(got, "owner_id", "entity", "status") == want


def test_unique_names_by_trial(spark):
    rnd = random.Random(7)
    old = [(0, n) for n in {rnd.choice(["a", "a (1)", "a (3)", "b", "a (07)", "c (2)", "b (1)"]) for _ in range(6)}]
    new = [(0, i, rnd.choice(["a", "b", "c", "a (1)", "c (2)", "d"])) for i in range(60)]
    got = {r.seq: r.unique_name for r in P.unique_names(spark.createDataFrame(old, "k int, name string"), spark.createDataFrame(new, "k int, seq bigint, name string"), ["k"]).collect()}
    taken = {n for _, n in old}
    want = {}
    for _, i, n in new:
        if n not in taken:
            want[i] = n
            taken.add(n)
    for _, i, n in new:
        if i not in want:
            k = 1
            while f"{n} ({k})" in taken:
                k += 1
            want[i] = f"{n} ({k})"
            taken.add(want[i])
    assert got == want
    assert len(set(got.values())) == len(new)


def test_unique_filenames_count_on_from_the_base(spark):
    media = spark.createDataFrame([("p", "txt", "a"), ("p", "txt", "a(1)"), ("p", "txt", "a(3)"), ("q", "txt", "a")], "parent_id string, extension string, user_filename string")
    new = spark.createDataFrame([("p", "txt", 1, "a"), ("p", "txt", 2, "a(3)"), ("p", "txt", 3, "b(2)"), ("q", "txt", 4, "a"), ("p", "md", 5, "a")], "parent_id string, extension string, seq bigint, name string")
    assert rows(P.unique_filenames(media, new), "seq", "unique_name") == [(1, "a(2)"), (2, "a(4)"), (3, "b(2)"), (4, "a(1)"), (5, "a")]


def test_word_scores(spark):
    index = spark.createDataFrame([("h", 1, "report"), ("h", 1, "reporting"), ("h", 2, "reporter"), ("h", 3, "re"), ("h", 4, "ärger"), ("h", 5, "go")], "hub_id string, nid int, word string")
    asked = spark.createDataFrame([(1, "report, xx"), (2, "re"), (3, "är"), (4, "GO!")], "query_id int, string string")
    assert rows(S.word_search(asked, index, None), "query_id", "nid", "score", "word") == [
        (1, 1, 160, "report"), (1, 2, 60, "reporter"), (2, 3, 120, "re"), (3, 4, 30, "ärger"), (4, 5, 120, "go")]


def test_closure_survives_a_cycle(spark):
    tag = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x")], "tag_id string, parent_tag_id string")
    got = rows(trees.tag_closure(tag), "ancestor", "descendant", "depth")
    assert ("a", "c", 2) in got and ("x", "y", 1) in got and len(got) == 3 + 2 + 1 + 4


def test_grants_on_a_deep_chain(spark):
    media = spark.createDataFrame([("n0", "0")] + [(f"n{i}", f"n{i - 1}") for i in range(1, 40)], "id string, parent_id string").withColumn("hub_id", F.lit("h"))
    rules = spark.createDataFrame([("n3", "u", 7, 0, "near"), ("n0", "v", 1, 50, "top"), ("n20", "w", 3, 9, ""), ("*", "w", 15, 0, "wide")],
                                  "resource_id string, entity_id string, permission int, expiry_time bigint, message string").withColumn("hub_id", F.lit("h"))
    near = dict(rows(nearest_grant(media, rules), "id", "resource_id"))
    assert near["n2"] == "n0" and near["n19"] == "n3" and near["n39"] == "n20"
    ask = spark.createDataFrame([("u", "n39"), ("v", "n39"), ("w", "n20"), ("w", "n39"), ("z", "n39"), ("u", "n2")], "uid string, node_id string").withColumn("hub_id", F.lit("h"))
    assert rows(effective_grant(ask, media, rules), "uid", "node_id", "permission", "expiry_time") == [
        ("u", "n2", 0, 0), ("u", "n39", 7, 0), ("v", "n39", 1, 50), ("w", "n20", 3, 9), ("w", "n39", 15, 0), ("z", "n39", 0, 0)]


def test_csv_headings(spark):
    csv = spark.createDataFrame([
        (1, "o", "Ann", "Lee", "bad", "a@b.co", "work", "+33 6-12", "0612", "1 Rue, Bat A,Paris,France", "x@y.zz"),
        (2, "o", None, None, "", None, "work", None, None, "Nowhere", "nope")],
        "row_no int, owner_id string, `Given Name` string, `Family  name` string, `E-mail 1` string, Email2 string, `E-mail type` string, Phone string, mobile string, `Address home` string, `e--mail` string")
    a, b = sorted(I.normalise_csv(csv).collect(), key=lambda r: r.row_no)
    assert (a.firstname, a.lastname, a.emails) == ("Ann", "Lee", ["a@b.co", "x@y.zz"])
    assert [(p.phone, p.areacode) for p in a.phones] == [("6 12", "+33"), ("0612", "")]
    assert [tuple(x) for x in a.addresses] == [("1 Rue, Bat A", "Paris", "France")]
    assert b.emails == [] and [tuple(x) for x in b.addresses] == [("Nowhere", "", "")]


def test_vcard_round_trip(spark, tmp_path):
    exported = spark.createDataFrame([
        ("o", "a@b.co", "Ann", "Lee", "Al", "Ann Lee", "https://d/avatar/u1", "123---WORK:::456---HOME:::123---WORK", '{"street":"1 Rue","city":"Paris","country":"FR"}---HOME', 1),
        ("o", "no@b.co", None, None, None, "x y", None, None, '{"street":"1 Rue"}---HOME', 1)],
        "owner_id string, email string, firstname string, lastname string, surname string, fullname string, avatar string, phone string, address string, part int")
    cards = I.export_vcards(exported)
    text = {r.email: r.vcard for r in cards.collect()}
    assert text["a@b.co"].split("\n")[:4] == ["BEGIN:VCARD", "VERSION:4.0", "N:Ann;Lee;Al;.;", "FN:Ann Lee"]
    assert text["a@b.co"].count("TEL;TYPE=WORK,voice;VALUE=uri:tel:123\n") == 1
    assert text["no@b.co"] == "BEGIN:VCARD\nVERSION:4.0\nFN:x y\nEMAIL:no@b.co\nEND:VCARD\n"
    I.write_vcards(cards, str(tmp_path / "cards"))
    back = I.read_vcards(spark, str(tmp_path / "cards"))
    assert back.count() == 2
    parsed = {r.emails[0]: r for r in I.normalise_vcards(back.withColumns({"row_no": F.monotonically_increasing_id(), "owner_id": F.lit("o")})).collect()}
    assert parsed["a@b.co"].phones[0].phone == "123" and parsed["no@b.co"].firstname == "no"


def test_foreign_vcards(spark):
    text = "BEGIN:VCARD\r\nVERSION:3.0\r\nN:Doe;Jane;;;\r\nEMAIL;TYPE=WORK:jane.doe@x.org\r\nEMAIL:second@x.org\r\nTEL;TYPE=\"cell:1\":+1 555\r\nADR;TYPE=HOME:;;12 Long\r\n  Road;Town;ST;999;Land\r\n"
    cards = spark.createDataFrame([(1, "o", text), (2, "o", "BEGIN:VCARD\nEMAIL:jim.beam@x.org\n")], "row_no int, owner_id string, text string")
    jane, jim = sorted(I.normalise_vcards(cards).collect(), key=lambda r: r.row_no)
    assert (jane.firstname, jane.lastname, jane.emails) == ("Jane", "Doe", ["jane.doe@x.org", "second@x.org"])
    assert jane.phones[0].phone == "+1 555" and tuple(jane.addresses[0]) == ("12 Long Road", "Town ST", "Land")
    assert (jim.firstname, jim.lastname) == ("jim", "beam")


def test_members(spark):
    members = spark.createDataFrame([
        (1, "A", "", "a@x.co", "0612345", "+33", "ID1"), (2, "", "", "a@x.co", "abc", "", "id1"), (3, "", "", "", "", "", ""), (4, "B", "", "taken@x.co", "0612345", "+1", "used"), (5, "C", "", "a@x.co", "0612345", "+1", "id5")],
        "row_no int, firstname string, lastname string, email string, mobile string, areacode string, ident string").withColumn("domain_id", F.lit(1))
    users = spark.createDataFrame([("taken@x.co", "USED", 1)], "email string, username string, domain_id int")
    got = {r["index"]: r for r in I.validate_members(members, users).collect()}
    assert sorted(got) == [1, 2, 4, 5]
    assert got[1].errorstatus == [] and got[1].error == 0
    assert got[2].errorstatus == ["EMPTY_NAMES", "EMPTY_AREACODE", "INVALID_PHONE_FORMAT", "IDENT_DUPLICATE (1)", "EMAIL_DUPLICATE (1)"]
    assert got[4].errorstatus == ["EMAIL_NOT_AVAILABLE", "IDENT_NOT_AVAILABLE"]
    assert got[5].errorstatus == ["EMAIL_DUPLICATE (2)"] and got[5].email_earlier == 2


def test_assigned_contacts(spark):
    new = spark.createDataFrame([("n1", "o1", "new"), ("n2", "o1", "new")], "uid string, org_id string, status string")
    members = spark.createDataFrame([("o1", "m1"), ("o1", "n1"), ("o2", "m2")], "org_id string, uid string")
    assert rows(I.assigned_contacts(new, members, spark.createDataFrame([("n1",)], "uid string"))) == [("n1", "m1")]


def test_deep_trees_lose_nothing(spark):
    hub = F.lit("h").alias("hub_id")
    media = spark.createDataFrame([(f"n{k}", f"n{k - 1}" if k else "0") for k in range(400)], "id string, parent_id string").select("*", hub)
    rule = "resource_id string, entity_id string, permission int, expiry_time int, message string"
    grants = spark.createDataFrame([("n0", "u", 7, 0, "")], rule).select("*", hub)
    assert {r["resource_id"] for r in G.nearest_grant(media, grants).collect()} == {"n0"}
    asked = spark.createDataFrame([("u", "n399"), ("v", "n399")], "uid string, node_id string").select("*", hub)
    assert rows(G.effective_grant(asked, media, grants), "uid", "permission") == [("u", 7), ("v", 0)]
    every = grants.unionByName(spark.createDataFrame([(f"n{k}", "w", 3, 0, "") for k in range(1, 400)], rule).select("*", hub))
    rounds = []
    cut, forest.cut_lineage = forest.cut_lineage, lambda df: rounds.append(1) or cut(df)
    try:
        assert rows(G.effective_grant(asked, media, every), "uid", "permission") == [("u", 7), ("v", 0)]
    finally:
        forest.cut_lineage = cut
    assert len(rounds) < 50  # 400 granted nodes in a row
    tags = spark.createDataFrame([(f"t{k}", f"t{k - 1}" if k else None) for k in range(1200)] + [("a", "b"), ("b", "a")], "tag_id string, parent_tag_id string")
    left, _ = trees.tag_remove(tags, spark.createDataFrame([("o", "x", "t9")], "owner_id string, id string, tag_id string"), spark.createDataFrame([("t1",)], "tag_id string"))
    assert rows(left, "tag_id") == [("a",), ("b",), ("t0",)]


def test_cyclic_parents_and_room_grants(spark):
    media = spark.createDataFrame([("h1", "x", "y"), ("h1", "y", "x"), ("h1", "n", "0"), ("h2", "n", "0")], "hub_id string, id string, parent_id string")
    grants = spark.createDataFrame([("h1", "*", "u", 63, 0, "")], "hub_id string, resource_id string, entity_id string, permission int, expiry_time int, message string")
    asked = spark.createDataFrame([("h1", "u", "n"), ("h2", "u", "n"), ("h1", "w", "x")], "hub_id string, uid string, node_id string")
    assert rows(G.effective_grant(asked, media, grants), "hub_id", "node_id", "permission") == [("h1", "n", 63), ("h1", "x", 0), ("h2", "n", 0)]


def test_unread_of_two_owners_and_double_contacts(spark):
    unread = spark.createDataFrame([("o1", "u", 3), ("o2", "u", 5)], "owner_id string, entity_id string, room_count bigint")
    none = spark.createDataFrame([], "uid string, hub_id string, room_count bigint")
    contact = spark.createDataFrame([("o1", "c1", "u"), ("o1", "c2", "u"), ("o2", "c1", "u")], "owner_id string, id string, uid string")
    mapped = spark.createDataFrame([("o1", "c1", "t"), ("o1", "c2", "t"), ("o2", "c1", "t")], "owner_id string, id string, tag_id string")
    tag = spark.createDataFrame([("o1", "t", None, "T", 0), ("o1", "k", "t", "K", 1), ("o2", "t", None, "T", 0), ("o1", "z", None, "Z", 2), ("o3", "t", None, "T", 0)], "owner_id string, tag_id string, parent_tag_id string, name string, position int")
    counts = M.tag_counts(tag, M.unread_by_tag(unread, none, contact, mapped))
    assert rows(counts, "owner_id", "tag_id", "room_count", "is_any_child") == [("o1", "t", 3, 1), ("o1", "z", 0, 0), ("o2", "t", 5, 0), ("o3", "t", 0, 0)]


def test_long_words_stay_apart(spark):
    docs = spark.createDataFrame([("h", "1", "x" * 400 + "a " + "x" * 400 + "b")], "hub_id string, nid string, text string")
    assert S.index_build(docs).count() == 2


LANG = "hub_id string, sys_id bigint, base string, state string"
LANG_CHANGE = "seq bigint, hub_id string, base string, state string"


def test_only_the_change_that_takes_the_last_language_is_refused(spark):
    languages = spark.createDataFrame([("h", 1, "a", "active"), ("h", 2, "b", "active"), ("k", 3, "a", "active"), ("n", 4, "a", "frozen"), ("n", 5, "b", "active")], LANG)
    changes = spark.createDataFrame([(1, "h", "a", "frozen"), (2, "h", "b", "frozen"), (1, "n", "a", "active"), (2, "n", "b", "deleted"), (3, "n", "a", "deleted"), (4, "n", "zz", "frozen")], LANG_CHANGE)
    want = [("h", "a", "frozen"), ("h", "b", "active"), ("k", "a", "active"), ("n", "a", "active"), ("n", "b", "deleted")]
    assert rows(JR.language_state(languages, changes), "hub_id", "base", "state") == want
    assert rows(JR.language_state(languages, changes, chunk=1), "hub_id", "base", "state") == want
    assert rows(JR.language_state(languages, changes.limit(0)), "hub_id", "base", "state") == rows(languages, "hub_id", "base", "state")


def test_quoted_line_breaks_stay_in_their_cell(spark, tmp_path):
    (tmp_path / "c.csv").write_text('first name,note\nAnn,"one\ntwo ""three"""\nBob,x\n')
    assert rows(I.read_contact_csv(spark, str(tmp_path))) == [("Ann", 'one\ntwo "three"'), ("Bob", "x")]


def test_an_invalid_batch_is_refused_whole(spark):
    kind = "index int, email string, firstname string, lastname string, ident string, mobile string, areacode string, error int"
    good, bad = (1, "a@x.co", "A", "B", "id1", "1", "2", 0), (2, "b@x.co", "", "", "id2", "1", "2", 1)
    assert [t.count() for t in I.load_members(spark.createDataFrame([good], kind), "o")] == [1, 1]
    assert [t.count() for t in I.load_members(spark.createDataFrame([good, bad], kind), "o")] == [0, 0]


def test_files_of_two_rooms_with_one_id(spark):
    media = spark.createDataFrame([("h1", "d1", "u", "f", "image", "t", "m", 5), ("h2", "d1", "v", "g", "image", "t", "m", 7)],
                                  "hub_id string, id string, owner_id string, user_filename string, category string, extension string, mimetype string, filesize bigint")
    inbox = spark.createDataFrame([("a", "b", "m1", '[{"hub_id":"h2","nid":"d1"}]')], "owner_id string, entity_id string, message_id string, attachment string")
    assert rows(M.message_attachments(inbox, media), "hub_id", "nid", "user_filename") == [("h2", "d1", "g")]
    assert rows(JM.deleted_files(inbox, inbox.limit(0), media)) == [("h2", "d1", 7)]


def test_a_stranger_gets_no_relation_row(spark):
    events = spark.createDataFrame([(1, "a", "x@mail", "invite"), (2, "a", "b", "invite")], "seq bigint, actor string, target string, event string")
    users = spark.createDataFrame([("a",), ("b",)], "id string")
    assert rows(JC.invitation_fold(events, user_dir=users), "owner_id", "entity", "status") == [("a", "b", "sent"), ("a", "x@mail", "sent"), ("b", "a", "received")]


def test_pages_of_a_type_reach_every_row(spark):
    block = spark.createDataFrame([(f"p{k:02d}", "page", k, "u") for k in range(7)], "id string, type string, mtime int, author_id string")
    users = spark.createDataFrame([("u", "F", "L")], "id string, firstname string, lastname string")
    got = [r["id"] for page in (1, 2, 3) for r in sorted(P.block_list(block, users, page=page, rows=3).collect(), key=lambda r: r["place"])]
    assert got == [f"p{k:02d}" for k in range(6, -1, -1)]


def test_an_ident_is_taken_in_its_domain_only(spark):
    members = spark.createDataFrame([(1, 1, "used"), (2, 2, "used"), (3, 2, "used"), (4, 1, "free"), (5, 2, "free")], "row_no int, domain_id int, ident string").select(
        "*", F.lit("A").alias("firstname"), F.lit("B").alias("lastname"), F.concat(F.lit("m"), F.col("row_no").cast("string"), F.lit("@x.co")).alias("email"), F.lit("0612345").alias("mobile"), F.lit("+33").alias("areacode"))
    users = spark.createDataFrame([("z@x.co", "Used", 1)], "email string, username string, domain_id int")
    got = {r["index"]: r["errorstatus"] for r in I.validate_members(members, users).collect()}
    assert got == {1: ["IDENT_NOT_AVAILABLE"], 2: [], 3: ["IDENT_DUPLICATE (2)"], 4: [], 5: []}


def test_a_reply_keeps_its_thread(spark):
    posts = spark.createDataFrame([(1, "a", "b", "m1", "hi", None), (2, "b", "a", "m2", "yes", "m1")], "seq bigint, author_id string, entity_id string, message_id string, message string, thread_id string").select(
        "*", F.lit(None).cast("string").alias("attachment"), F.lit(5).alias("ctime"), F.lit(None).cast("string").alias("forward_message_id"), F.lit(None).cast("string").alias("forward_hub_id"))
    empty = spark.createDataFrame([], "owner_id string, entity_id string, message_id string, sys_id bigint")
    new = JM.post_messages(posts, empty)
    contact = spark.createDataFrame([], "owner_id string, sys_id bigint, id string, entity string")
    assert rows(M.message_threads(new, contact), "owner_id", "message_id", "thread_id", "thread_message") == [("a", "m2", "m1", "hi"), ("b", "m2", "m1", "hi")]
    team = JM.post_team_messages(posts.withColumn("hub_id", F.lit("h")), spark.createDataFrame([], "hub_id string, message_id string, sys_id bigint"))
    assert rows(team, "message_id", "thread_id") == [("m1", None), ("m2", "m1")]


CHANGE = "seq bigint, op string, master_id string, lang string, device string, author_id string, hashtag string, isonline int, ctime bigint, target bigint, copy_id string"


def revised(spark, history, changes):
    stored = spark.createDataFrame(history, "serial bigint, master_id string, lang string, device string, isonline int").select("*", F.lit("a").alias("author_id"), F.lit(0).cast("bigint").alias("ctime"))
    block = spark.createDataFrame([("p", "one"), ("q", "two")], "id string, hashtag string")
    full = [(s, op, m, lang, device, "a", tag, online, 0, target, copy) for s, op, m, lang, device, tag, online, target, copy in changes]
    out = JR.revisions(stored, block, spark.createDataFrame(full, CHANGE))
    state = {(r["serial"], r["master_id"], r["lang"], r["device"]): (r["status"], r["isonline"], r["active"]) for r in out["history"].collect()}
    return state, rows(out["block"], "id", "hashtag", "active"), rows(out["refused"], "seq", "reason")


def test_two_pages_that_save_one_new_name(spark):
    _, pages, refused = revised(spark, [(1, "p", "en", "d", 0), (2, "q", "en", "d", 0)], [
        (1, "save", "q", "en", "d", "same", 0, None, None), (2, "save", "p", "en", "d", "same", 0, None, None), (3, "rename", "p", None, None, "two", 0, None, None), (4, "archive", "p", "en", "d", None, 0, None, None),
        (5, "save", "q", "en", "d", "same", 0, None, None)])
    assert pages == [("p", "one", 1), ("q", "same", 8)] and refused == [(2, "hash_exist"), (3, "hash_exist"), (4, "unknown_op")]


def test_publish_copy_and_delete_of_a_language(spark):
    history = [(1, "p", "en", "d", 0), (2, "p", "en", "d", 1), (3, "p", "fr", "d", 1), (4, "p", "fr", "m", 0), (5, "q", "fr", "d", 1)]
    state, pages, refused = revised(spark, history, [
        (1, "publish", "p", "en", "d", None, 0, 1, None), (2, "copy", "p", "es", None, None, 0, 3, None), (3, "copy", "p", "fr", None, None, 0, 2, None), (4, "copy", "p", "en", None, "fresh", 0, 2, "n"),
        (5, "publish", "p", "fr", "d", None, 0, 1, None), (6, "copy", "p", "es", None, None, 0, 99, None)])
    assert refused == [(3, "confirm_copy"), (5, "unknown_revision"), (6, "unknown_revision")]
    assert state[1, "p", "en", "d"] == ("draft", 1, 8) and state[2, "p", "en", "d"] == ("history", 0, 8) and state[8, "p", "es", "d"] == ("draft", 0, 8) and state[10, "n", "en", "d"] == ("draft", 0, 10)
    assert ("n", "fresh", 10) in pages
    state, pages, _ = revised(spark, history, [(1, "unpublish", "p", "en", "d", None, 0, None, None), (2, "publish", "p", "en", "d", None, 0, 2, None), (3, "delete_lang", "p", "fr", None, None, 0, None, None)])
    assert sorted(state) == [(1, "p", "en", "d"), (2, "p", "en", "d"), (5, "q", "fr", "d")] and state[2, "p", "en", "d"] == ("draft", 1, 2)
    state, pages, _ = revised(spark, history, [(1, "delete_lang", None, "fr", None, None, 0, None, None), (2, "save", "p", "fr", "m", None, 1, None, None)])
    assert [x for x, *_ in pages] == ["p"] and state[8, "p", "fr", "m"] == ("draft", 1, 8) and len(state) == 3


def test_clearing_one_room_or_inbox(spark):
    rooms = spark.createDataFrame([("u", "h1", "private"), ("u", "h2", "private"), ("v", "h1", "private")], "owner_id string, hub_id string, area string")
    marks = spark.createDataFrame([("h1", "v", 9), ("h1", "u", 2), ("h2", "v", 7), ("h2", "u", 1)], "hub_id string, uid string, ref_sys_id bigint")
    one = spark.createDataFrame([("u", "h1")], "uid string, entity_id string")
    assert rows(JM.clear_team_markers(one, rooms, marks)) == [("h1", "u", 9), ("h1", "v", 9), ("h2", "u", 1), ("h2", "v", 7)]
    everything = spark.createDataFrame([("u", None), ("u", "h1")], "uid string, entity_id string")
    assert rows(JM.clear_team_markers(everything, rooms, marks)) == [("h1", "u", 9), ("h1", "v", 9), ("h2", "u", 7), ("h2", "v", 7)]


def test_whole_lists_without_pages(spark):
    log = spark.createDataFrame([("h", k, "u", "media", "all", "u", "x", k) for k in range(60)], "hub_id string, sys_id bigint, uid string, category string, notify_to string, entity_id string, log string, ctime bigint").withColumn("action", F.lit("backup"))
    people = spark.createDataFrame([("u", "A", "B")], "id string, firstname string, lastname string")
    members = spark.createDataFrame([("h", "u", 63)], "hub_id string, uid string, permission int")
    assert N.action_log_feed(log, members, people).count() == 45 and N.action_log_feed(log, members, people, None).count() == 60 and N.backup_log(log, None).count() == 60
