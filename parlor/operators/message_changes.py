"""Posting, acknowledging and deleting messages, call logs, clearing notifications."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlor.operators.messaging import fully_deleted
from parlor.operators.rooms import disk_adjust
from parlor.plans.skew import rank_in_groups

BOX = ["owner_id", "entity_id"]
NODES = "array<struct<hub_id:string,nid:string>>"


def both_inboxes(posts: DataFrame) -> DataFrame:
    """``posts(seq, author_id, entity_id, message_id, …)`` as one row per inbox; the other side sees the author as entity."""
    sides = F.array(F.struct(F.col("author_id").alias("owner_id"), F.col("entity_id")), F.struct(F.col("entity_id").alias("owner_id"), F.col("author_id").alias("entity_id")))
    rest = [c for c in posts.columns if c != "entity_id"]
    return posts.select(*rest, F.explode(sides).alias("side")).select(*rest, "side.owner_id", "side.entity_id")


def fresh(rows: DataFrame, existing: DataFrame, tenant: str) -> DataFrame:
    """First row per (tenant, message_id) that the tenant does not have yet."""
    keys = [tenant, "message_id"]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in keys]), "seq").alias("r")).select(*keys, "r.*")
    return first.join(existing.select(*keys), keys, "left_anti")


def _numbered(rows: DataFrame, existing: DataFrame, tenant: str) -> DataFrame:
    top = existing.groupBy(tenant).agg(F.max("sys_id").alias("top"))
    return rank_in_groups(rows, [tenant], "seq", "_n").join(top, tenant, "left").withColumn("sys_id", F.coalesce("top", F.lit(0)) + F.col("_n")).drop("_n", "top")


def _delivered(*who: str):
    entries = [F.struct(F.col(w).alias("key"), F.col("ctime").alias("value")) for w in who]
    return F.map_from_entries(F.array_distinct(F.array(*entries)))


def post_messages(posts: DataFrame, channel: DataFrame) -> DataFrame:
    """New inbox rows of private posts: each message once per inbox, numbered on from the inbox's last position.

    Posting an id again changes nothing.  An empty text becomes NULL; ``thread_id`` names the message answered.  ``metadata`` starts with the author in
    ``_seen_`` and both sides in ``_delivered_``, and names the origin of a forwarded message.
    """
    rows = _numbered(fresh(both_inboxes(posts), channel, "owner_id"), channel, "owner_id")
    other = F.when(F.col("author_id") == F.col("owner_id"), F.col("entity_id")).otherwise(F.col("owner_id"))
    forwarded = F.col("forward_message_id").isNotNull()
    meta = F.to_json(F.struct(
        F.create_map(F.col("author_id"), F.lit(1)).alias("_seen_"), _delivered("author_id", "_other").alias("_delivered_"), "forward_message_id",
        F.when(forwarded, F.col("forward_hub_id")).alias("forward_hub_id")))
    return rows.withColumn("_other", other).select(
        *BOX, "sys_id", "author_id", "message_id", F.nullif("message", F.lit("")).alias("message"), "thread_id", "attachment", "ctime",
        F.when(forwarded, F.lit(1)).otherwise(F.lit(0)).alias("is_forward"), meta.alias("metadata"))


def post_team_messages(posts: DataFrame, team_channel: DataFrame) -> DataFrame:
    """New room rows; receivers and readers are kept as rows elsewhere, not written into each message."""
    rows = _numbered(fresh(posts, team_channel, "hub_id"), team_channel, "hub_id")
    return rows.select("hub_id", "sys_id", "author_id", "message_id", F.nullif("message", F.lit("")).alias("message"), "thread_id", "attachment", "ctime")


def markers_after_post(new_rows: DataFrame, team_read: DataFrame) -> DataFrame:
    """An author has read the room up to the own message."""
    own = new_rows.select("hub_id", F.col("author_id").alias("uid"), F.col("sys_id").alias("ref_sys_id"))
    return team_read.select("hub_id", "uid", "ref_sys_id").unionByName(own).groupBy("hub_id", "uid").agg(F.max("ref_sys_id").alias("ref_sys_id"))


def apply_acks(acks: DataFrame, channel: DataFrame, read_channel: DataFrame) -> DataFrame:
    """Read markers after ``acks(uid, entity_id, message_id)``: raised on both sides, never lowered.

    The reader's marker rises in the own inbox and, as a mirror, in the other's; a missing marker of the other side
    starts at 0.  Unknown messages raise nothing.
    """
    asked = acks.select("uid", "entity_id", "message_id").distinct()
    at = channel.select("owner_id", "message_id", "sys_id")
    mine = asked.withColumn("owner_id", F.col("uid")).join(at, ["owner_id", "message_id"]).select("owner_id", "entity_id", "uid", F.col("sys_id").alias("ref_sys_id"))
    his = asked.withColumn("owner_id", F.col("entity_id")).join(at, ["owner_id", "message_id"]).select("owner_id", F.col("uid").alias("entity_id"), "uid", F.col("sys_id").alias("ref_sys_id"))
    zero = F.lit(0).cast("bigint").alias("ref_sys_id")
    other_mine = mine.select("owner_id", "entity_id", F.col("entity_id").alias("uid"), zero)
    other_his = his.select("owner_id", "entity_id", F.col("owner_id").alias("uid"), zero)
    rows = read_channel.select("owner_id", "entity_id", "uid", "ref_sys_id")
    for more in (mine, his, other_mine, other_his):
        rows = rows.unionByName(more)
    return rows.groupBy("owner_id", "entity_id", "uid").agg(F.max("ref_sys_id").alias("ref_sys_id"))


def delete_status(requests: DataFrame, channel: DataFrame, tenant: str) -> DataFrame:
    """``requests(request_id, tenant, uid, option, message_id)``, several ids per request: one status per request.

    Unknown options, unknown messages and "all" by someone else than the author are refused.
    """
    known = channel.select(tenant, "message_id", "author_id")
    seen = requests.join(known, [tenant, "message_id"], "left")
    per = seen.groupBy("request_id").agg(
        F.max(F.when(~F.col("option").isin("me", "all"), 1).otherwise(0)).alias("bad_option"), F.max(F.when(F.col("author_id").isNull(), 1).otherwise(0)).alias("unknown"),
        F.max(F.when((F.col("option") == "all") & (F.col("author_id") != F.col("uid")), 1).otherwise(0)).alias("not_author"))
    status = F.when(F.col("bad_option") == 1, "INVALID_OPTION").when(F.col("unknown") == 1, "INVALID_MESSAGES").when(F.col("not_author") == 1, "INVALID_OPTION").otherwise("OK")
    return per.select("request_id", status.alias("status"))


def valid_deletes(requests: DataFrame, channel: DataFrame, tenant: str) -> DataFrame:
    ok = delete_status(requests, channel, tenant).where("status = 'OK'").select("request_id")
    return requests.join(ok, "request_id", "left_semi")


def apply_deletes(requests: DataFrame, channel: DataFrame) -> DataFrame:
    """Private inboxes after the valid requests: the own copy goes, and with "all" the other's too."""
    valid = valid_deletes(requests.withColumn("owner_id", F.col("uid")), channel, "owner_id")
    own = valid.select("owner_id", "message_id")
    all_ = valid.where("option = 'all'").select("message_id", "owner_id").join(channel.select("owner_id", "message_id", "entity_id"), ["owner_id", "message_id"])
    gone = own.unionByName(all_.select(F.col("entity_id").alias("owner_id"), "message_id")).distinct()
    return channel.join(gone, ["owner_id", "message_id"], "left_anti")


def deleted_files(before: DataFrame, after: DataFrame, hub_media: DataFrame) -> DataFrame:
    """Attached files, known by room and id, of messages that no inbox holds any more."""
    lost = before.where("attachment IS NOT NULL").join(after.select("message_id"), "message_id", "left_anti")
    nodes = lost.select(F.explode(F.from_json("attachment", NODES)).alias("n")).select("n.hub_id", F.col("n.nid").alias("id")).distinct()
    return hub_media.join(nodes, ["hub_id", "id"], "left_semi").select("hub_id", "id", "filesize")


def usage_after(disk_usage: DataFrame, files: DataFrame) -> DataFrame:
    return disk_adjust(disk_usage, files)


def apply_team_deletes(requests: DataFrame, team_channel: DataFrame, team_delete: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Room messages and tombstones after ``requests(request_id, hub_id, uid, option, message_id)``.

    "me" leaves a tombstone of the member.  "all" would leave one for everybody, after which the message goes for
    good; it goes at once, without writing those.  A message whose last member deletes it goes too.
    """
    valid = valid_deletes(requests, team_channel, "hub_id").join(team_channel.select("hub_id", "message_id", "sys_id"), ["hub_id", "message_id"])
    for_all = valid.where("option = 'all'").select("hub_id", F.col("sys_id").alias("ref_sys_id"))
    mine = valid.where("option = 'me'").select("hub_id", "uid", F.col("sys_id").alias("ref_sys_id"))
    stones = team_delete.select("hub_id", "uid", "ref_sys_id").unionByName(mine).distinct()
    gone = for_all.unionByName(fully_deleted(stones, members)).distinct()
    left = team_channel.join(gone.withColumnRenamed("ref_sys_id", "sys_id"), ["hub_id", "sys_id"], "left_anti")
    return left, stones.join(gone, ["hub_id", "ref_sys_id"], "left_anti")


def _asked(rows: DataFrame, users: DataFrame, entity: str) -> DataFrame:
    """Rows ``(uid, …)`` that ``users(uid, entity_id)`` clear: all of a user's where ``entity_id`` is NULL or missing from the table, else those of that inbox or room."""
    if "entity_id" not in users.columns:
        return rows.join(users.select("uid").distinct(), "uid", "left_semi")
    everything = users.where("entity_id IS NULL").select("uid").distinct()
    single = users.where("entity_id IS NOT NULL").select("uid", F.col("entity_id").alias(entity)).distinct()
    return rows.join(everything, "uid", "left_semi").unionByName(rows.join(everything, "uid", "left_anti").join(single, ["uid", entity], "left_semi"))


def clear_team_markers(users: DataFrame, rooms: DataFrame, team_read: DataFrame) -> DataFrame:
    """Markers after ``users(uid[, entity_id])`` cleared everything, or one room: in these rooms up to the highest marker of the room."""
    top = team_read.groupBy("hub_id").agg(F.max("ref_sys_id").alias("top"))
    cleared = _asked(rooms.where(F.col("area").isin("private", "share", "public")).select("hub_id", F.col("owner_id").alias("uid")), users, "hub_id").distinct()
    raised = cleared.join(top, "hub_id", "left").select("hub_id", "uid", F.coalesce("top", F.lit(0)).alias("ref_sys_id"))
    return team_read.select("hub_id", "uid", "ref_sys_id").join(raised.select("hub_id", "uid"), ["hub_id", "uid"], "left_anti").unionByName(raised)


def clear_file_markers(users: DataFrame, rooms: DataFrame, hub_media: DataFrame) -> DataFrame:
    """Per cleared (room, user): all files up to ``seen_upto`` count as seen; one row instead of one per file."""
    top = hub_media.groupBy("hub_id").agg(F.max("sys_id").alias("seen_upto"))
    cleared = _asked(rooms.where(F.col("area").isin("private", "share", "public")).select("hub_id", F.col("owner_id").alias("uid")), users, "hub_id").distinct()
    return cleared.join(top, "hub_id")


def clear_private_markers(users: DataFrame, read_channel: DataFrame) -> DataFrame:
    """The own marker of a clearing user is restated from the other side's."""
    others = read_channel.where("uid <> owner_id").select(F.col("owner_id").alias("uid"), "entity_id", "ref_sys_id")
    other = _asked(others, users, "entity_id").groupBy(F.col("uid").alias("owner_id"), "entity_id").agg(F.max("ref_sys_id").alias("ref_sys_id"))
    mine = other.select(*BOX, F.col("owner_id").alias("uid"), "ref_sys_id")
    kept = read_channel.select(*BOX, "uid", "ref_sys_id").join(mine.select(*BOX, "uid"), [*BOX, "uid"], "left_anti")
    return kept.unionByName(mine)


def clear_ticket_markers(users: DataFrame, ticket: DataFrame, read_ticket: DataFrame) -> DataFrame:
    """Tickets are cleared together, not one by one."""
    every = users.where("entity_id IS NULL") if "entity_id" in users.columns else users
    own = ticket.join(every.select("uid").distinct(), "uid", "left_semi").select("ticket_id", "uid")
    top = read_ticket.groupBy("ticket_id").agg(F.max("ref_sys_id").alias("ref_sys_id"))
    raised = own.join(top, "ticket_id").select("ticket_id", "uid", "ref_sys_id")
    return read_ticket.select("ticket_id", "uid", "ref_sys_id").join(raised.select("ticket_id", "uid"), ["ticket_id", "uid"], "left_anti").unionByName(raised)


def call_posts(calls: DataFrame) -> DataFrame:
    """Caller's cancel, leave and reject events as messages of type ``call`` on both sides."""
    kept = calls.where((F.col("role") == "caller") & F.col("type").isin("cancel", "leave", "reject"))
    sides = both_inboxes(kept.select("seq", "author_id", "entity_id", "message_id", "type", "duration", "ctime"))
    role = F.when(F.col("owner_id") == F.col("author_id"), "caller").otherwise("callee")
    meta = F.to_json(F.struct(F.lit("call").alias("message_type"), F.col("type").alias("call_status"), F.coalesce("duration", F.lit(0)).alias("duration"), role.alias("role")))
    return sides.select("seq", *BOX, "author_id", "message_id", F.lit("call").alias("message"), "ctime", meta.alias("metadata"))


def call_log(calls: DataFrame, channel: DataFrame) -> DataFrame:
    rows = _numbered(fresh(call_posts(calls), channel, "owner_id"), channel, "owner_id")
    return rows.select(*BOX, "sys_id", "author_id", "message_id", "message", "ctime", "metadata")


def ticket_posts(posts: DataFrame, ticket: DataFrame, read_ticket: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tickets with their last position and markers after support messages ``posts(ticket_id, author_id, sys_id)``."""
    last = posts.groupBy("ticket_id").agg(F.max("sys_id").alias("new_last"))
    tickets = ticket.join(last, "ticket_id", "left").select("ticket_id", "uid", F.greatest("last_sys_id", "new_last").alias("last_sys_id"))
    own = posts.join(ticket.select("ticket_id"), "ticket_id", "left_semi").select("ticket_id", F.col("author_id").alias("uid"), F.col("sys_id").alias("ref_sys_id"))
    marks = read_ticket.select("ticket_id", "uid", "ref_sys_id").unionByName(own).groupBy("ticket_id", "uid").agg(F.max("ref_sys_id").alias("ref_sys_id"))
    return tickets, marks
