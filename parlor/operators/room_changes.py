"""Grants, membership, revisions, tags, languages and subscriptions under a change set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlor.functions import expr as X
from parlor.operators.changes import upsert
from parlor.operators.grants import expiry_from_hours
from parlor.operators.pages import unique_names
from parlor.operators.trees import tag_closure, tag_cycle_check
from parlor.plans.skew import rank_in_groups
from parlor.session import cut_lineage

GRANT = ["hub_id", "resource_id", "entity_id"]
CHUNK = 4096


def apply_grants(grants: DataFrame, changes: DataFrame, now_epoch: int) -> DataFrame:
    """``grants(hub_id, resource_id, entity_id, permission, expiry_time, assign_via)`` after
    ``changes(seq, op, …, permission, hours, assign_via)`` with op ``grant`` or ``revoke``.

    A revoke without entity clears the resource; revoking the public grantee also clears its link grants.  A room
    that would lose its owner keeps its old grants altogether.
    """
    cols = [*GRANT, "permission", "expiry_time", "assign_via"]
    wide = changes.where((F.col("op") == "revoke") & (F.col("entity_id") == "")).groupBy("hub_id", "resource_id").agg(F.max("seq").alias("wide_seq"))
    link = changes.where((F.col("op") == "revoke") & F.col("entity_id").isin("nobody", "*")).groupBy("hub_id", "resource_id").agg(F.max("seq").alias("link_seq"))
    one = changes.where(F.col("entity_id") != "")
    old = grants.select(*cols, F.lit(None).cast("bigint").alias("seq"), F.lit("grant").alias("op"))
    asked = one.withColumn("expiry_time", expiry_from_hours(F.col("hours"), now_epoch)).select(*cols, "seq", "op")
    last = old.unionByName(asked).groupBy(*GRANT).agg(
        F.max_by(F.struct("op", "permission", "expiry_time", "assign_via", "seq"), F.coalesce("seq", F.lit(-1))).alias("r")).select(*GRANT, "r.*")
    at = F.coalesce("seq", F.lit(-1))
    after = last.join(wide, ["hub_id", "resource_id"], "left").join(link, ["hub_id", "resource_id"], "left").where("op = 'grant'").where(
        F.col("wide_seq").isNull() | (at > F.col("wide_seq"))).where(
        F.col("link_seq").isNull() | (F.coalesce("assign_via", F.lit("")) != "link") | (at > F.col("link_seq")))
    owned = after.where((F.col("resource_id") == "*") & (F.col("permission") == X.OWNER_MASK)).select("hub_id").distinct()
    return after.join(owned, "hub_id", "left_semi").select(*cols).unionByName(grants.select(*cols).join(owned, "hub_id", "left_anti"))


def make_owner(grants: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests(hub_id, uid)``: the room-wide owner grant moves to the user."""
    cols = [*GRANT, "permission", "expiry_time", "assign_via"]
    rooms = requests.groupBy("hub_id").agg(F.min("uid").alias("uid"))
    new = rooms.select("hub_id", F.lit("*").alias("resource_id"), F.col("uid").alias("entity_id"), F.lit(X.OWNER_MASK).alias("permission"),
                       F.lit(0).cast("bigint").alias("expiry_time"), F.lit("system").alias("assign_via"))
    is_owner = (F.col("resource_id") == "*") & (F.col("permission") == X.OWNER_MASK)
    kept = grants.select(*cols).join(rooms.select("hub_id", F.lit(1).alias("moves")), "hub_id", "left").where(~is_owner | F.col("moves").isNull()).drop("moves")
    return kept.join(new.select(*GRANT), GRANT, "left_anti").unionByName(new)


def membership(members: DataFrame, changes: DataFrame) -> DataFrame:
    """``members(hub_id, uid, permission)`` after joins, leaves and leave-all: ``changes(seq, op, hub_id, uid, permission)``.

    ``leave_all`` has no room and clears every room of the user up to its place in the order.
    """
    keys = ["hub_id", "uid"]
    everything = changes.where("op = 'leave_all'").groupBy("uid").agg(F.max("seq").alias("all_seq"))
    rows = members.select(*keys, "permission", F.lit(-1).cast("bigint").alias("seq"), F.lit("join").alias("op")).unionByName(
        changes.where("op <> 'leave_all'").select(*keys, "permission", "seq", "op"))
    last = rows.groupBy(*keys).agg(F.max_by(F.struct("op", "permission", "seq"), "seq").alias("r")).select(*keys, "r.*")
    return last.join(everything, "uid", "left").where("op = 'join'").where(F.col("all_seq").isNull() | (F.col("seq") > F.col("all_seq"))).select(*keys, "permission")


def desk_nodes(members: DataFrame, hub: DataFrame) -> DataFrame:
    """The room's node on each member's desk; unsafe characters of the name become ``-``."""
    name = F.regexp_replace("name", "(/+)|(<.*>)|<+|>+", "-")
    return members.select("hub_id", F.col("uid").alias("owner_id")).join(hub.select(F.col("id").alias("hub_id"), name.alias("user_filename")), "hub_id").select(
        "owner_id", F.col("hub_id").alias("id"), "user_filename", F.lit("hub").alias("category"))


def offboard(members: DataFrame, leavers: DataFrame) -> DataFrame:
    """New owners of the rooms that ``leavers(uid)`` own: another owner, else an admin, else any member (first by id)."""
    gone = leavers.select("uid").distinct().withColumn("gone", F.lit(1))
    tagged = members.join(gone, "uid", "left")
    lost = tagged.where((F.col("gone") == 1) & (F.col("permission") == X.OWNER_MASK)).select("hub_id").distinct()
    rank = F.when(F.col("permission") == X.OWNER_MASK, 0).when(X.has_bit("permission", X.ADMIN_BIT), 1).otherwise(2)
    return tagged.where("gone IS NULL").join(lost, "hub_id", "left_semi").groupBy("hub_id").agg(F.min_by("uid", F.struct(rank, F.col("uid"))).alias("uid"))


PAGE_OPS = ("save", "rename", "publish", "unpublish", "copy", "delete_lang", "purge")


def _refusals(history: DataFrame, block: DataFrame, changes: DataFrame) -> DataFrame:
    """The changes with ``page``, the device of what they copy, and the ``reason`` why they are refused, else NULL."""
    op, own = F.col("op"), F.col("master_id")
    copied = (op == "copy") & F.col("copy_id").isNotNull()
    source = history.select(F.col("serial").alias("target"), F.col("master_id").alias("of"), F.col("lang").alias("from_lang"), F.col("device").alias("from_device"))
    asked = changes.join(source, "target", "left").withColumn("page", F.when(copied, F.col("copy_id")).otherwise(own))
    # a name that no page holds goes to the page of its first claim in the batch
    held = block.select("hashtag", F.col("id").alias("holder"))
    claims = asked.where(op.isin("save", "rename") | copied).where("hashtag IS NOT NULL").join(held, "hashtag", "left")
    first = claims.where("holder IS NULL").groupBy("hashtag").agg(F.min_by("page", "seq").alias("winner"))
    clash = claims.join(first, "hashtag", "left").where(F.coalesce("holder", "winner") != F.col("page")).select("seq", F.lit(True).alias("clash")).distinct()
    place = [own.alias("p"), F.col("lang").alias("l"), F.col("device").alias("d")]
    there = history.select(*place, F.lit(-1).cast("bigint").alias("s")).unionByName(changes.where("op = 'save'").select(*place, F.col("seq").cast("bigint").alias("s")))
    there = there.groupBy("p", "l", "d").agg(F.min("s").alias("since"))
    seen = asked.join(clash, "seq", "left").join(there, (own == F.col("p")) & (F.col("lang") == F.col("l")) & (F.col("from_device") == F.col("d")), "left")
    no_source = F.col("of").isNull() | (F.col("of") != own) | ((op == "publish") & (F.col("from_lang") != F.col("lang")))
    reason = (
        F.when(op.isNull() | ~op.isin(*PAGE_OPS), "unknown_op").when(op.isin("publish", "copy") & no_source, "unknown_revision")
        .when(F.col("clash"), "hash_exist").when((op == "copy") & F.col("copy_id").isNull() & (F.col("since") < F.col("seq")), "confirm_copy"))
    return seen.withColumn("reason", reason).drop("p", "l", "d", "since", "clash", "of", "from_lang")


def revisions(history: DataFrame, block: DataFrame, changes: DataFrame) -> dict[str, DataFrame]:
    """Page history and pages after ``changes(seq, op, master_id, lang, device, author_id, hashtag, isonline, ctime, target, copy_id)``.

    ``save`` appends a revision; ``rename`` names the page; ``publish`` makes revision ``target`` of the page and language its draft and the one online;
    ``unpublish`` takes a language and device offline; ``copy`` appends revision ``target`` as a draft in ``lang``, on a page of its own where ``copy_id``
    names one; ``delete_lang`` drops a language and device, on all devices where that is NULL, from all pages where ``master_id`` is NULL; ``purge`` drops
    the page. A page without revisions goes.

    ``refused`` holds the changes that do nothing: ``hash_exist`` (the name belongs to another page, or an earlier change of the batch gave it to one; a name
    that is given up is free from the next batch on), ``confirm_copy`` (the page had that language and device before), ``unknown_revision``, ``unknown_op``.
    """
    judged = cut_lineage(_refusals(history, block, changes))
    ok, refused = judged.where("reason IS NULL"), judged.where("reason IS NOT NULL")
    page, lang = ["master_id", "lang", "device"], ["master_id", "lang"]
    top = history.agg(F.coalesce(F.max("serial"), F.lit(0))).scalar()

    def last(op: str, keys: list[str], name: str, test: str = "true") -> DataFrame:
        return ok.where(f"op = '{op}' AND {test}").groupBy(*keys).agg(F.max("seq").alias(name))

    copy = F.col("op") == "copy"
    cols = ["serial", "master_id", "author_id", "lang", "device", "isonline", "ctime", "seq"]
    saved = ok.where(F.col("op").isin("save", "copy")).select(
        (top + 1 + F.col("seq")).alias("serial"), F.col("page").alias("master_id"), "author_id", "lang", F.when(copy, F.col("from_device")).otherwise(F.col("device")).alias("device"),
        F.when(copy, F.lit(0)).otherwise(F.col("isonline")).alias("isonline"), "ctime", "seq")
    rows = history.withColumn("seq", F.lit(-1).cast("bigint")).select(*cols).unionByName(saved.select(*cols))
    gone = [(["master_id"], last("purge", ["master_id"], "g0")), (page, last("delete_lang", page, "g1", "device IS NOT NULL")),
            (lang, last("delete_lang", lang, "g2", "device IS NULL AND master_id IS NOT NULL")), (["lang"], last("delete_lang", ["lang"], "g3", "master_id IS NULL"))]
    for keys, table in gone:
        rows = rows.join(table, keys, "left")
    stays = F.col("seq") > F.greatest(F.lit(-2), "g0", "g1", "g2", "g3")
    rows = rows.where(stays).join(last("publish", ["target"], "shown_at").withColumnRenamed("target", "serial"), "serial", "left").join(last("unpublish", page, "off_at"), page, "left")
    # a page's revisions in the order in which they were last made the draft or put online
    online = F.greatest(F.when(F.col("isonline") == 1, F.col("seq")), "shown_at")
    rows = cut_lineage(rows.select(*cols, F.greatest("seq", "shown_at").alias("drafted"), F.when(F.col("off_at").isNull() | (online > F.col("off_at")), online).alias("online")))
    newest = F.max(F.struct("drafted", "serial"))["serial"]
    shown = rows.groupBy(*lang).agg(newest.alias("draft_id"), F.max(F.when(F.col("online").isNotNull(), F.struct("online", "serial")))["serial"].alias("online_id"))
    active = rows.groupBy("master_id").agg(newest.alias("active"))
    state = rows.join(shown, lang).join(active, "master_id").select(
        "serial", *lang, F.when(F.col("serial") == F.col("draft_id"), "draft").otherwise("history").alias("status"),
        X.flag(F.col("serial").eqNullSafe(F.col("online_id"))).alias("isonline"), "active", "author_id", "device", "ctime")
    named = ok.where(F.col("op").isin("save", "rename") | (copy & F.col("copy_id").isNotNull())).where("hashtag IS NOT NULL").groupBy(F.col("page").alias("id")).agg(F.max_by("hashtag", "seq").alias("new_tag"))
    pages = active.withColumnRenamed("master_id", "id").join(block.select("id", "hashtag"), "id", "left").join(named, "id", "left").select("id", F.coalesce("new_tag", "hashtag").alias("hashtag"), "active")
    return {"history": state, "block": pages, "refused": refused.select("seq", "op", "master_id", "hashtag", "reason", X.flag(F.col("reason") == "hash_exist").alias("hash_exist"))}


def tag_edit(tag: DataFrame, changes: DataFrame) -> DataFrame:
    """Tags after ``changes(seq, op, tag_id, parent_tag_id, name)``: added tags take the next position and a free name,
    ``rename`` sets the name, ``assign`` the parent unless that closes a cycle, ``remove`` drops the tag with all below.
    """
    added = changes.where("op = 'add'").groupBy("tag_id").agg(F.min_by(F.struct("seq", "parent_tag_id", "name"), "seq").alias("a")).select("tag_id", "a.*").join(tag.select("tag_id"), "tag_id", "left_anti")
    scoped = cut_lineage(added.withColumn("scope", F.lit(0)))
    names = unique_names(tag.select(F.lit(0).alias("scope"), "name"), scoped.select("scope", "seq", "name"), ["scope"]).select("seq", "unique_name")
    last = tag.agg(F.coalesce(F.max("position"), F.lit(0))).scalar()
    placed = rank_in_groups(scoped, ["scope"], "seq", "_n").join(names, "seq").select(
        "tag_id", "parent_tag_id", F.col("unique_name").alias("name"), (last + F.col("_n")).cast("int").alias("position"))
    now = cut_lineage(tag.select("tag_id", "parent_tag_id", "name", "position").unionByName(placed))
    renamed = changes.where("op = 'rename'").groupBy("tag_id").agg(F.max_by("name", "seq").alias("new_name"))
    moves = changes.where("op = 'assign'").groupBy("tag_id").agg(F.max_by("parent_tag_id", "seq").alias("parent_tag_id"))
    fine = tag_cycle_check(tag_closure(now, moves), moves).where("is_cycle = 0").select("tag_id", F.col("parent_tag_id").alias("new_parent"), F.lit(1).alias("moved"))
    edited = now.join(renamed, "tag_id", "left").join(fine, "tag_id", "left").select(
        "tag_id", F.when(F.col("moved") == 1, F.col("new_parent")).otherwise(F.col("parent_tag_id")).alias("parent_tag_id"), F.coalesce("new_name", "name").alias("name"), "position")
    edited = cut_lineage(edited)
    gone = tag_closure(edited, changes.where("op = 'remove'").select("tag_id")).select(F.col("descendant").alias("tag_id")).distinct()
    return edited.join(gone, "tag_id", "left_anti")


def language_state(language: DataFrame, changes: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Languages after ``changes(seq, hub_id, base, state)``, one after the other by ``seq``, which is unique in a room.

    A change to ``frozen`` or ``deleted`` is refused while the room has at most one active language; it alone, not the room's other changes.
    Whether a change is refused hangs on all before it, so a room's list of languages is carried through its changes, ``chunk`` of them at a time.
    """
    known = changes.join(language.select("hub_id", "base"), ["hub_id", "base"], "left_semi").select("seq", "hub_id", "base", "state")
    ranked = cut_lineage(rank_in_groups(known, ["hub_id"], "seq", "_r").withColumn("_chunk", F.expr(f"CAST((_r - 1) DIV {int(chunk)} AS BIGINT)")))
    chunks = ranked.agg(F.coalesce(F.max("_chunk") + 1, F.lit(0)).alias("n")).first()["n"]
    rooms = language.groupBy("hub_id").agg(F.collect_list(F.struct("sys_id", "base", "state")).alias("now"))

    def applied(now: Column, change: Column) -> Column:
        last = F.size(F.filter(now, lambda x: x["state"] == "active")) <= 1
        moved = F.transform(now, lambda x: F.struct(
            x["sys_id"].alias("sys_id"), x["base"].alias("base"), F.when(x["base"] == change["base"], change["state"]).otherwise(x["state"]).alias("state")))
        return F.when(last & F.lower(change["state"]).isin("frozen", "deleted"), now).otherwise(moved)

    for k in range(chunks):
        own = ranked.where(F.col("_chunk") == k).groupBy("hub_id").agg(F.array_sort(F.collect_list(F.struct("seq", "base", "state"))).alias("es"))
        both = rooms.join(own, "hub_id", "left")
        rooms = cut_lineage(both.select("hub_id", F.when(F.col("es").isNull(), F.col("now")).otherwise(F.aggregate("es", F.col("now"), applied)).alias("now")))
    return rooms.select("hub_id", F.inline("now"))


# Billing event types and the plans of the account.
PAID, FAILED = "invoice.paid", "invoice.payment_failed"
CREATED, UPDATED, DELETED = "customer.subscription.created", "customer.subscription.updated", "customer.subscription.deleted"
EXPIRED, BASIC, PRO = "incomplete_expired", "basic", "pro"


def billing_kind(events: DataFrame) -> DataFrame:
    """Route an event: ``row`` (created, updated), ``ended`` (deleted, or expired before completion), ``paid``, ``failed``."""
    ends = (F.col("type") == DELETED) | ((F.col("type") == UPDATED) & (F.col("status") == EXPIRED))
    kind = F.when(ends, "ended").when(F.col("type").isin(CREATED, UPDATED), "row").when(F.col("type") == PAID, "paid").when(F.col("type") == FAILED, "failed")
    return events.withColumn("kind", kind).where("kind IS NOT NULL")


BILLING_KEYS = ("entity_id", "kind")


def billing_last() -> list:
    """Aggregates per account and kind: the last event and how many there were.  Also the state of the stream."""
    return [F.max("seq").alias("seq"), F.max_by(F.struct("subscription_id", "status"), "seq").alias("last"), F.count(F.lit(1)).alias("n")]


def subscription_state(last: DataFrame) -> DataFrame:
    """Account row from the last event per kind.

    Paid: renewal and plan quota.  Failed: open.  Created or updated: the subscription's row.  Ended: no row, basic plan.
    """
    k = F.col("kind")

    def latest(test, value):
        return F.max_by(F.when(test, value), F.when(test, F.col("seq")))

    return last.groupBy("entity_id").agg(
        latest(k.isin("row", "ended"), F.struct("kind", "last")).alias("s"), latest(k.isin("paid", "failed"), k).alias("payment"),
        F.max(F.when(k == "paid", F.col("seq"))).alias("renewed_seq"), F.max(F.when(k == "ended", F.col("seq"))).alias("ended_seq"),
        F.coalesce(F.max(F.when(k == "paid", F.col("n"))), F.lit(0)).alias("n_paid"),
    ).select(
        "entity_id", F.when(F.col("s.kind") == "row", F.col("s.last.subscription_id")).alias("subscription_id"), F.when(F.col("s.kind") == "row", F.col("s.last.status")).alias("status"),
        F.when(F.col("payment") == "failed", F.lit("open")).when(F.col("payment") == "paid", F.lit("paid")).alias("payment"), "renewed_seq", "n_paid",
        F.when(F.col("renewed_seq").isNotNull() & (F.col("ended_seq").isNull() | (F.col("renewed_seq") > F.col("ended_seq"))), F.lit(PRO)).otherwise(F.lit(BASIC)).alias("plan"))


def subscription_fold(events: DataFrame) -> DataFrame:
    """Subscription and plan per account after ``events(seq, entity_id, subscription_id, type, status)``."""
    return subscription_state(billing_kind(events).groupBy(*BILLING_KEYS).agg(*billing_last()))


def index_upsert(index: DataFrame, changes: DataFrame) -> DataFrame:
    """Indexed content of a page and language, ``(key, content, hashtag)`` with key ``id-lang``, replaced by the last change."""
    keyed = changes.select(F.concat_ws("-", "id", "lang").alias("key"), "content", "hashtag", "seq", F.lit("upsert").alias("op"))
    return upsert(index, keyed, ["key"])
