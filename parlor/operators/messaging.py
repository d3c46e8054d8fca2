"""Direct messages and team rooms: unread counts, last messages, pages, threads, room lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlor.functions import expr as X
from parlor.operators.contacts import archived_keys, default_email, uid_flags
from parlor.plans.skew import PAGE_ROWS, count_upto, first_not_excluded, paginate, rank_in_groups

BOX = ["owner_id", "entity_id"]


def my_markers(read_channel: DataFrame) -> DataFrame:
    return read_channel.where("uid = owner_id").select(*BOX, F.col("ref_sys_id").alias("my_ref"))


def unread_items(channel: DataFrame, read_channel: DataFrame) -> DataFrame:
    """Messages of the other side beyond the owner's marker.  Rooms without a marker have none."""
    return channel.where("entity_id = author_id").join(my_markers(read_channel), BOX).where("sys_id > my_ref").drop("my_ref")


def unread_direct(channel: DataFrame, read_channel: DataFrame) -> DataFrame:
    return unread_items(channel, read_channel).groupBy(*BOX).agg(F.count(F.lit(1)).alias("room_count"))


def pages_to_read(unread: DataFrame, rows: int = PAGE_ROWS) -> DataFrame:
    return unread.select(*BOX, (F.floor(F.col("room_count") / rows) + 1).alias("page"))


def unread_summary(unread: DataFrame, owner: str = "owner_id", room: str = "entity_id") -> DataFrame:
    """``total`` over all rooms of the reader next to the count of each ``room``."""
    total = unread.groupBy(owner).agg(F.sum("room_count").alias("total"))
    return unread.select(owner, room, F.col("room_count").alias("room")).join(total, owner)


def unread_team(team_channel: DataFrame, team_read: DataFrame) -> DataFrame:
    """Messages of others beyond each member's marker: ``(hub_id, uid, room_count)``.

    Per marker: all messages of the room, minus those up to the marker, minus the member's own beyond it; all three come from one
    shuffle of messages and markers.  Linear in messages + markers; no member x message pair is formed.  A member without a marker has no row.
    """
    markers = team_read.select("hub_id", "uid", F.col("ref_sys_id").alias("sys_id"))
    messages = team_channel.select("hub_id", F.col("author_id").alias("uid"), "sys_id")
    counted = count_upto(messages, markers, ["hub_id"], "sys_id", "upto", total="total", own=("uid", "own"))
    return counted.select("hub_id", "uid", (F.col("total") - F.col("upto") - F.col("own")).alias("room_count"))


def newest_unread_team(team_channel: DataFrame, team_read: DataFrame) -> DataFrame:
    """Position and time of each member's newest unread message, from the two latest authors of a room."""
    by_author = team_channel.groupBy("hub_id", "author_id").agg(F.max("sys_id").alias("last_id"))
    top = by_author.groupBy("hub_id").agg(F.max(F.struct("last_id", "author_id")).alias("top"))
    second = (
        by_author.join(top, "hub_id").where(F.col("author_id") != F.col("top.author_id"))
        .groupBy("hub_id").agg(F.max("last_id").alias("second"))
    )
    last = F.when(F.col("uid") == F.col("top.author_id"), F.col("second")).otherwise(F.col("top.last_id"))
    at = team_channel.select("hub_id", "sys_id", F.col("ctime").alias("last_ctime"))
    return (
        team_read.join(top, "hub_id").join(second, "hub_id", "left").withColumn("sys_id", last)
        .where("sys_id > ref_sys_id").join(at, ["hub_id", "sys_id"]).select("hub_id", "uid", "sys_id", "last_ctime")
    )


def last_message(channel: DataFrame) -> DataFrame:
    """Last message per private room; the state behind previews is derived, never stored."""
    row = F.struct("sys_id", F.left("message", F.lit(X.PREVIEW)).alias("message"), "ctime", "attachment", "metadata")
    return channel.groupBy(*BOX).agg(F.max_by(row, "sys_id").alias("m")).select(
        *BOX, F.col("m.sys_id").alias("ref_sys_id"), "m.message", "m.ctime", "m.metadata",
        X.flag(F.col("m.attachment").isNotNull()).alias("is_attachment"))


def last_team_message(team_channel: DataFrame, members: DataFrame, team_delete: DataFrame) -> DataFrame:
    """Last message each member still sees, past the ones they deleted; NULLs when nothing is left."""
    items = team_channel.select("hub_id", "sys_id", F.left("message", F.lit(X.PREVIEW)).alias("message"), "ctime",
                                X.flag(F.col("attachment").isNotNull()).alias("is_attachment"))
    gone = team_delete.select("hub_id", "uid", F.col("ref_sys_id").alias("sys_id"))
    return (
        first_not_excluded(items, members.select("hub_id", "uid"), gone, ["hub_id"], "uid", "sys_id")
        .withColumnRenamed("sys_id", "ref_sys_id").withColumn("is_attachment", F.coalesce("is_attachment", F.lit(0)))
    )


def message_page(channel: DataFrame, read_channel: DataFrame, page: int | None = None) -> DataFrame:
    """Messages of every private room with their page (45 rows, newest first) and read flags."""
    mine = my_markers(read_channel)
    his = read_channel.where("uid = entity_id").select(*BOX, F.col("ref_sys_id").alias("his_ref"))
    paged = rank_in_groups(channel.select(*BOX, "sys_id"), BOX, "sys_id", "_rank", desc=True).select(
        *BOX, "sys_id", X.page_of("_rank", PAGE_ROWS).alias("page"))
    if page is not None:
        paged = paged.where(F.col("page") == page)
    return (
        paged.join(channel, [*BOX, "sys_id"]).join(mine, BOX).join(his, BOX)
        .select(
            *BOX, "page", "sys_id", "author_id", "message", "message_id", "ctime", *message_columns(),
            X.flag(F.col("my_ref") < F.col("sys_id")).alias("is_notify"),
            X.flag(F.col("my_ref") >= F.col("sys_id")).alias("is_readed"),
            X.flag(F.col("his_ref") >= F.col("sys_id")).alias("is_seen"),
        )
    )


def message_columns() -> list:
    """Facts read from the JSON columns of a message."""
    return [
        F.get_json_object("attachment", "$[0]").alias("attachment_first"),
        F.json_array_length("attachment").alias("attachment_count"),
        X.flag(F.col("attachment").isNotNull() & (F.trim("attachment") != "")).alias("is_attachment"),
        X.message_type("metadata").alias("message_type"),
        F.get_json_object("metadata", "$.call_status").alias("call_status"),
        F.get_json_object("metadata", "$.duration").alias("call_duration"),
    ]


def late_page(channel: DataFrame, page: int = 1, rows: int = PAGE_ROWS) -> DataFrame:
    """Find the page on three narrow columns, then fetch the wide rows."""
    ids = paginate(channel.select(*BOX, "sys_id"), BOX, [F.col("sys_id").desc()], page, rows)
    return ids.join(channel, [*BOX, "sys_id"])


def message_get(channel: DataFrame, wanted: DataFrame, in_room: bool) -> DataFrame:
    """Messages by id; in a room ``is_seen`` compares readers with receivers, in an inbox it is 1."""
    def size(path: str):
        return F.size(F.json_object_keys(F.get_json_object("metadata", path)))

    seen = X.flag(size("$._seen_") >= size("$._delivered_")) if in_room else F.lit(1)
    return channel.join(wanted.select("message_id").distinct(), "message_id", "left_semi").withColumn("is_seen", seen)


def message_threads(thread_message: DataFrame, contact: DataFrame) -> DataFrame:
    """Each reply with its parent message and the parent author as the owner's contact; a missing parent reads DELETED."""
    parent = thread_message.select(
        *BOX, F.col("message_id").alias("thread_id"), F.col("message").alias("thread_message"), F.col("author_id").alias("thread_author_id"))
    who = contact.groupBy("owner_id", F.col("entity").alias("thread_author_id")).agg(F.min_by("id", "sys_id").alias("thread_contact_id"))
    replies = thread_message.where("thread_id IS NOT NULL")
    return (
        replies.join(parent, [*BOX, "thread_id"], "left").join(who, ["owner_id", "thread_author_id"], "left")
        .select(*BOX, "sys_id", "message_id", "thread_id", F.coalesce("thread_message", F.lit("DELETED")).alias("thread_message"),
                "thread_author_id", "thread_contact_id")
    )


def forward_messages(requests: DataFrame, team_channel: DataFrame) -> DataFrame:
    """``requests(request_id, hub_id, messages JSON)`` to one row per message, newest position last in, first out.

    ``node`` is the JSON that the receiving side stores; empty attachments are left out of it.
    """
    asked = requests.select(
        "request_id", "hub_id", F.json_array_length("messages").alias("n"), F.posexplode(F.from_json("messages", "array<string>")).alias("pos", "message_id"))
    attachment = F.nullif(F.col("attachment"), F.lit("[]"))
    return (
        asked.join(team_channel.select("hub_id", "message_id", "message", "attachment"), ["hub_id", "message_id"])
        .select(
            "request_id", "hub_id", F.col("message_id").alias("forward_message_id"), (F.col("n") - F.col("pos")).alias("place"),
            "message", attachment.alias("attachment"),
            F.to_json(F.struct(F.col("message_id").alias("forward_message_id"), "message", attachment.alias("attachment"), "hub_id")).alias("node"),
        )
    )


def message_attachments(channel: DataFrame, hub_media: DataFrame) -> DataFrame:
    """One row per message and attached file with the file's facts; ``position`` keeps the order of the list. A file is known by room and id."""
    nodes = channel.where("attachment IS NOT NULL").select(
        *BOX, "message_id", F.posexplode(F.from_json("attachment", "array<struct<hub_id:string,nid:string>>")).alias("position", "node"))
    files = hub_media.select(F.col("id").alias("nid"), "hub_id", "owner_id", "user_filename", "category", "extension",
                             "mimetype", "filesize").withColumnRenamed("owner_id", "file_owner_id")
    return nodes.select(*BOX, "message_id", "position", "node.hub_id", "node.nid").join(files, ["hub_id", "nid"])


def delivery_status(team_channel: DataFrame, team_read: DataFrame) -> DataFrame:
    """Members that received and that have seen each team message; seen when none is behind.

    Members whose marker is below a message are counted with one pass over markers and messages.
    """
    members = team_read.groupBy("hub_id").agg(F.count(F.lit(1)).alias("delivered"))
    probes = team_channel.select("hub_id", "message_id", (F.col("sys_id") - 1).alias("pos"))
    behind = count_upto(team_read.select("hub_id", F.col("ref_sys_id").alias("pos")), probes, ["hub_id"], "pos", "behind")
    return behind.join(members, "hub_id").select(
        "hub_id", "message_id", "delivered", (F.col("delivered") - F.col("behind")).alias("seen"), X.flag(F.col("behind") == 0).alias("is_seen"))


def fully_deleted(team_delete: DataFrame, members: DataFrame) -> DataFrame:
    """Team messages with a tombstone of every member: ``(hub_id, ref_sys_id)``."""
    size = members.groupBy("hub_id").agg(F.count_distinct("uid").alias("n_members"))
    return (
        team_delete.select("hub_id", "uid", "ref_sys_id").distinct()
        .join(members.select("hub_id", "uid").distinct(), ["hub_id", "uid"], "left_semi")
        .groupBy("hub_id", "ref_sys_id").agg(F.count(F.lit(1)).alias("n_gone"))
        .join(size, "hub_id").where("n_gone = n_members").select("hub_id", "ref_sys_id")
    )


def tickets_unread(ticket: DataFrame, read_ticket: DataFrame, user_dir: DataFrame, support_domain: int) -> DataFrame:
    """Open tickets per user: the support team answers for all, others for their own.

    For the team, the number of all tickets is corrected by the user's own markers instead of pairing users with tickets.
    """
    marks = ticket.select("ticket_id", F.col("uid").alias("author"), "last_sys_id").join(
        read_ticket.select("ticket_id", "uid", "ref_sys_id"), "ticket_id")
    open_ = F.col("last_sys_id") > F.col("ref_sys_id")
    per_user = marks.groupBy("uid").agg(
        F.count_if(open_ & (F.col("author") == F.col("uid"))).alias("own"),
        F.sum(F.when(open_, 1).otherwise(0) - F.when(F.col("last_sys_id") > 0, 1).otherwise(0)).alias("shift"),
    )
    everything = ticket.where("last_sys_id > 0").agg(F.count(F.lit(1))).scalar()
    team = F.col("domain_id") == support_domain
    count = F.when(team, everything + F.coalesce("shift", F.lit(0))).otherwise(F.coalesce("own", F.lit(0)))
    return user_dir.select(F.col("id").alias("uid"), "domain_id").join(per_user, "uid", "left").select("uid", count.alias("support_cnt"))


def _one_contact(contact: DataFrame) -> DataFrame:
    """``(owner_id, entity_id, id)``: of the contacts of one user in a book the one with the least id, so that counts are not doubled."""
    return contact.where("uid IS NOT NULL").groupBy("owner_id", F.col("uid").alias("entity_id")).agg(F.min("id").alias("id"))


def unread_dashboard(
    unread: DataFrame, unread_hub: DataFrame, contact: DataFrame, archive_entity: DataFrame, ticket: DataFrame,
    read_ticket: DataFrame, user_dir: DataFrame, support_domain: int = 0,
) -> DataFrame:
    """Counters of a user's start page; archived contacts and rooms go to their own counter, each by its own flag."""
    archived = archived_keys(archive_entity, "key")
    people = _one_contact(contact).withColumnRenamed("id", "key")
    direct = unread.join(people, BOX).select("owner_id", "key", "room_count", F.lit("contact").alias("kind"))
    rooms = unread_hub.where("room_count > 0").select(F.col("uid").alias("owner_id"), F.col("hub_id").alias("key"), "room_count", F.lit("share").alias("kind"))
    each = direct.unionByName(rooms).join(archived, ["owner_id", "key"], "left").withColumn("live", F.col("is_archived").isNull())
    sums = each.groupBy("owner_id").agg(
        F.sum(F.when((F.col("kind") == "share") & F.col("live"), F.col("room_count"))).alias("share"),
        F.sum(F.when((F.col("kind") == "contact") & F.col("live"), F.col("room_count"))).alias("direct"),
        F.sum(F.when(~F.col("live"), F.col("room_count"))).alias("archive"),
        F.count_if("live").alias("heads"),
    )
    tickets = tickets_unread(ticket, read_ticket, user_dir, support_domain).withColumnRenamed("uid", "owner_id")
    zero = F.lit(0)
    share, mine, old = F.coalesce("share", zero), F.coalesce("direct", zero), F.coalesce("archive", zero)
    return tickets.join(sums, "owner_id", "left").select(
        "owner_id", share.alias("share_chat_cnt"), mine.alias("contact_chat_cnt"), old.alias("archive_chat_cnt"), "support_cnt",
        F.coalesce("heads", zero).alias("head_chat_cnt"), (share + mine + old + F.col("support_cnt")).alias("total_cnt"))


def unread_by_tag(unread: DataFrame, unread_hub: DataFrame, contact: DataFrame, map_tag: DataFrame) -> DataFrame:
    """Unread messages per owner and tag, over tagged contacts and rooms."""
    direct = unread.join(_one_contact(contact), BOX).select("owner_id", "id", "room_count")
    rooms = unread_hub.select(F.col("uid").alias("owner_id"), F.col("hub_id").alias("id"), "room_count")
    return (
        direct.unionByName(rooms).join(map_tag.select("owner_id", "id", "tag_id"), ["owner_id", "id"])
        .groupBy("owner_id", "tag_id").agg(F.sum("room_count").alias("room_count"))
    )


def tag_counts(tag: DataFrame, by_tag: DataFrame) -> DataFrame:
    """Every owner's top-level tags ``tag(owner_id, tag_id, …)`` with child flag and unread count, 0 where nothing is unread."""
    own = ["owner_id", "tag_id"]
    parents = tag.where("parent_tag_id IS NOT NULL").select("owner_id", F.col("parent_tag_id").alias("tag_id")).distinct().withColumn("has", F.lit(1))
    counts = by_tag.groupBy(*own).agg(F.sum("room_count").alias("room_count"))
    return tag.where("parent_tag_id IS NULL").join(parents, own, "left").join(counts, own, "left").select(
        "owner_id", "tag_id", "parent_tag_id", "name", "position", F.coalesce("has", F.lit(0)).alias("is_any_child"),
        F.coalesce("room_count", F.lit(0)).alias("room_count"))


def chat_rooms(
    contact: DataFrame, contact_email: DataFrame, user_dir: DataFrame, socket: DataFrame, contact_block: DataFrame,
    archive_entity: DataFrame, channel: DataFrame, read_channel: DataFrame, rooms: DataFrame, team_channel: DataFrame,
    team_read: DataFrame, team_delete: DataFrame, map_tag: DataFrame | None = None, key: str | None = None, tag_id: str | None = None,
    flag: str | None = None, option: str | None = None, page: int | None = None, rows: int = PAGE_ROWS,
) -> DataFrame:
    """Room list of every owner: contacts, people written to without a contact, and private team rooms.

    ``rooms(owner_id, hub_id, name, area)`` are the rooms on the owner's desk.  ``flag`` is all, contact or share;
    an empty flag means all.
    """
    key = None if X.no_filter(key) else key
    tag_id = None if X.no_filter(tag_id) else tag_id
    flag = "all" if X.no_filter(flag) else flag
    archived = archived_keys(archive_entity, "arch_key")
    last = last_message(channel)
    unread = unread_direct(channel, read_channel)
    online = socket.where("state = 'active'").select(F.col("uid").alias("user_id")).distinct().withColumn("s", F.lit(1))
    null = F.lit(None).cast("string")
    branches = []
    if flag in ("all", "contact"):
        du = user_dir.select(F.col("id").alias("uid"), F.col("email").alias("du_email"))
        people = contact.where("uid IS NOT NULL").where(X.any_starts_with(["firstname", "lastname", "surname", "source"], key)).select(
            "owner_id", "id", "uid", "entity", "surname", "firstname", "lastname")
        if tag_id is not None:
            wanted = map_tag.where(F.col("tag_id") == tag_id).select("owner_id", "id")
            people = people.join(wanted, ["owner_id", "id"], "left_semi")
        branches.append(
            people.join(du, "uid").join(default_email(contact_email), ["owner_id", "id"], "left")
            .join(uid_flags(people, contact_block, user_dir), ["owner_id", "id"], "left")
            .join(last.withColumnRenamed("entity_id", "uid").drop("ref_sys_id"), ["owner_id", "uid"], "left")
            .join(unread.withColumnRenamed("entity_id", "uid"), ["owner_id", "uid"], "left")
            .select(
                "owner_id", F.col("uid").alias("entity_id"), F.col("owner_id").alias("hub_id"), F.col("uid").alias("user_id"),
                F.col("id").alias("contact_id"), "firstname", "lastname",
                X.display_name("surname", "firstname", "lastname", "ce_email", "du_email").alias("display"),
                F.coalesce("room_count", F.lit(0)).alias("room_count"), "message", "metadata", "ctime", F.lit("contact").alias("flag"),
                F.lit("active").alias("status"), "is_blocked", "is_blocked_me", F.coalesce("is_attachment", F.lit(0)).alias("is_attachment"),
                F.col("id").alias("arch_key"))
        )
        if tag_id is None and key is None:
            by_uid = contact.where("uid IS NOT NULL").select("owner_id", F.col("uid").alias("entity_id")).distinct()
            by_entity = contact.where("entity IS NOT NULL").select("owner_id", F.col("entity").alias("entity_id")).distinct().withColumn("known", F.lit(1))
            names = user_dir.select(F.col("id").alias("entity_id"), F.col("fullname").alias("display"))
            branches.append(
                last.join(by_uid, BOX, "left_anti").join(names, "entity_id").join(by_entity, BOX, "left")
                .select(
                    "owner_id", "entity_id", F.col("owner_id").alias("hub_id"), null.alias("user_id"), null.alias("contact_id"),
                    null.alias("firstname"), null.alias("lastname"), "display", F.lit(0).cast("bigint").alias("room_count"), "message",
                    null.alias("metadata"), "ctime", F.lit("contact").alias("flag"),
                    F.when(F.col("known") == 1, F.lit("memory")).otherwise(F.lit("nocontact")).alias("status"),
                    F.lit(0).alias("is_blocked"), F.lit(0).alias("is_blocked_me"), "is_attachment", F.col("entity_id").alias("arch_key"))
            )
    if flag in ("all", "share"):
        shared = rooms.where("area = 'private'").where(X.any_starts_with(["name"], key))
        if tag_id is not None:
            wanted = map_tag.where(F.col("tag_id") == tag_id).select("owner_id", F.col("id").alias("hub_id"))
            shared = shared.join(wanted, ["owner_id", "hub_id"], "left_semi")
        member = shared.select("hub_id", F.col("owner_id").alias("uid"))
        listed = shared.select("hub_id").distinct()
        team_channel, team_read, team_delete = (rows.join(listed, "hub_id", "left_semi") for rows in (team_channel, team_read, team_delete))
        counts = unread_team(team_channel, team_read).withColumnRenamed("uid", "owner_id")
        preview = last_team_message(team_channel, member, team_delete).withColumnRenamed("uid", "owner_id")
        branches.append(
            shared.join(counts, ["owner_id", "hub_id"], "left").join(preview, ["owner_id", "hub_id"], "left")
            .select(
                "owner_id", F.col("hub_id").alias("entity_id"), "hub_id", null.alias("user_id"), null.alias("contact_id"),
                null.alias("firstname"), null.alias("lastname"), F.col("name").alias("display"), F.coalesce("room_count", F.lit(0)).alias("room_count"),
                "message", null.alias("metadata"), "ctime", F.lit("share").alias("flag"), F.lit("active").alias("status"),
                F.lit(0).alias("is_blocked"), F.lit(0).alias("is_blocked_me"), F.coalesce("is_attachment", F.lit(0)).alias("is_attachment"),
                F.col("hub_id").alias("arch_key"))
        )
    out = branches[0]
    for other in branches[1:]:
        out = out.unionByName(other)
    out = out.join(archived, ["owner_id", "arch_key"], "left").withColumn("is_archived", F.coalesce("is_archived", F.lit(0)))
    if option in ("archived", "active"):
        out = out.where(F.col("is_archived") == (1 if option == "archived" else 0))
    out = out.join(online, "user_id", "left").withColumn("online", F.coalesce("s", F.lit(0))).drop("s", "arch_key")
    if page is not None:
        out = paginate(out, ["owner_id"], [F.coalesce("ctime", F.lit(0)).desc(), F.col("entity_id").asc()], page, rows)
    return out


def group_chat_rooms(
    rooms: DataFrame, team_channel: DataFrame, team_read: DataFrame, team_delete: DataFrame, key: str | None = None,
) -> DataFrame:
    """Team rooms only, any area, with unread count and last message."""
    wanted = rooms.where(X.any_starts_with(["name"], key))
    member = wanted.select("hub_id", F.col("owner_id").alias("uid"))
    counts = unread_team(team_channel, team_read).withColumnRenamed("uid", "owner_id")
    last = last_team_message(team_channel, member, team_delete).withColumnRenamed("uid", "owner_id")
    return (
        wanted.join(counts, ["owner_id", "hub_id"], "left").join(last, ["owner_id", "hub_id"], "left")
        .select("owner_id", F.col("hub_id").alias("id"), F.col("name").alias("group_name"), F.coalesce("room_count", F.lit(0)).alias("room_count"), "message", "ctime")
    )


def chat_room_info(room_list: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of the room list by room id or by contact id: ``wanted(owner_id, key)``."""
    keyed = room_list.withColumn("key", F.explode(F.array_compact(F.array_distinct(F.array("entity_id", "contact_id")))))
    return keyed.join(wanted.select("owner_id", "key").distinct(), ["owner_id", "key"], "left_semi").drop("key").distinct()

