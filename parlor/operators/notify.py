"""Notification feed, action log and sign-in history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlor.functions import expr as X
from parlor.operators.contacts import PENDING, default_email
from parlor.operators.messaging import unread_items
from parlor.plans.skew import count_in_blocks, count_upto, first_not_excluded, list_in_parts, paginate, top_in_groups

ITEM = ["owner_id", "resource_id", "entity_id", "hub_id", "ctime", "area", "category", "cnt"]
TICKETS = "Support Ticket"
#: Members of the support team in a block, on average.
TEAM_BLOCK = 64


def seen_rows(hub_media: DataFrame) -> DataFrame:
    """``(hub_id, sys_id, uid)`` of the ``_seen_`` map, one row per reader."""
    return hub_media.select("hub_id", "sys_id", F.explode(F.map_keys(X.seen_map("metadata"))).alias("uid"))


def new_files(hub_media: DataFrame, members: DataFrame, cleared: DataFrame | None = None) -> DataFrame:
    """Files that are new to each member: ``(hub_id, uid, cnt, ctime)`` with the newest one's time.

    New to a member = all candidate files of the room minus those the member owns or has seen; the newest
    comes from the first gap in the member's exclusions.  Linear in files, readers and members.
    ``cleared(hub_id, uid, seen_upto)`` of ``clear_file_markers``: files up to ``seen_upto`` are not new to that member.
    """
    candidates = hub_media.where(X.is_visible("file_path", "category")).where(F.get_json_object("metadata", "$._seen_").isNotNull())
    files = candidates.select("hub_id", "sys_id", F.col("upload_time").alias("ctime"))
    known = seen_rows(candidates).unionByName(candidates.select("hub_id", "sys_id", F.col("owner_id").alias("uid")))
    total = files.groupBy("hub_id").agg(F.count(F.lit(1)).alias("total"))
    people = members.select("hub_id", "uid")
    if cleared is None:
        people = people.withColumns({"seen_upto": F.lit(None).cast("bigint"), "upto": F.lit(0).cast("bigint")})
    else:
        marks = cleared.groupBy("hub_id", "uid").agg(F.max("seen_upto").alias("seen_upto"))
        known = known.join(marks, ["hub_id", "uid"], "left").where("seen_upto IS NULL OR sys_id > seen_upto").drop("seen_upto")
        # a room's markers share few positions
        upto = count_in_blocks(files.select("hub_id", "sys_id"), marks.withColumnRenamed("seen_upto", "sys_id"), ["hub_id"], "sys_id", "upto")
        people = people.join(upto.select("hub_id", "uid", F.col("sys_id").alias("seen_upto"), "upto"), ["hub_id", "uid"], "left").withColumn("upto", F.coalesce("upto", F.lit(0)))
    newest = first_not_excluded(files, people, known, ["hub_id"], "uid", "sys_id", hidden_count="known")
    return (
        newest.where("sys_id IS NOT NULL AND (seen_upto IS NULL OR sys_id > seen_upto)").join(total, "hub_id")
        .select("hub_id", "uid", (F.col("total") - F.col("upto") - F.col("known")).alias("cnt"), "ctime")
    )


def team_pending(team_channel: DataFrame, team_read: DataFrame) -> DataFrame:
    """Team messages beyond each marker, own ones included: ``(hub_id, uid, cnt, ctime)``."""
    markers = team_read.select("hub_id", "uid", F.col("ref_sys_id").alias("sys_id"))
    counted = count_upto(team_channel.select("hub_id", "sys_id", "ctime"), markers, ["hub_id"], "sys_id", "upto", total="total", newest="ctime")
    return counted.where("total > upto").select("hub_id", "uid", (F.col("total") - F.col("upto")).alias("cnt"), "ctime")


def ticket_items(ticket: DataFrame, read_ticket: DataFrame, user_dir: DataFrame, support_domain: int, unmarked: bool = True) -> DataFrame:
    """Open tickets: authors see their own, the support team all.

    A team member gets one row per open ticket with a marker of theirs and one row ``unmarked`` that counts
    the tickets they never opened; without ``unmarked`` these are left to ``unmarked_tickets``, which lists them.
    """
    team = user_dir.where(F.col("domain_id") == support_domain).select(F.col("id").alias("owner_id"))
    t = ticket.select("ticket_id", F.col("uid").alias("author"), "last_sys_id")
    marks = read_ticket.select("ticket_id", F.col("uid").alias("owner_id"), "ref_sys_id", "ctime")
    own = (
        t.withColumnRenamed("author", "owner_id").join(marks, ["ticket_id", "owner_id"], "left")
        .where(F.col("last_sys_id") > F.coalesce("ref_sys_id", F.lit(0))).join(team, "owner_id", "left_anti")
        .select("owner_id", "ticket_id", "ctime", F.lit(1).cast("bigint").alias("cnt"))
    )
    handled = t.join(marks, "ticket_id").join(team, "owner_id", "left_semi")
    marked = handled.where("last_sys_id > ref_sys_id").select("owner_id", "ticket_id", "ctime", F.lit(1).cast("bigint").alias("cnt"))
    if not unmarked:
        return own.unionByName(marked).select("owner_id", F.col("ticket_id").cast("string").alias("entity_id"), "ctime", "cnt")
    touched = handled.where("last_sys_id > 0").groupBy("owner_id").agg(F.count(F.lit(1)).alias("touched"))
    everything = ticket.where("last_sys_id > 0").agg(F.count(F.lit(1))).scalar()
    rest = team.join(touched, "owner_id", "left").select(
        "owner_id", F.lit(None).cast("bigint").alias("ticket_id"), F.lit(None).cast("bigint").alias("ctime"),
        (everything - F.coalesce("touched", F.lit(0))).alias("cnt")).where("cnt > 0")
    return own.unionByName(marked).unionByName(rest).select(
        "owner_id", F.coalesce(F.col("ticket_id").cast("string"), F.lit("unmarked")).alias("entity_id"), "ctime", "cnt")


def unmarked_tickets(ticket: DataFrame, read_ticket: DataFrame, user_dir: DataFrame, support_domain: int = 0) -> tuple[DataFrame, DataFrame]:
    """Every open ticket with every member of the support team who has no marker on it, as two tables: ``(entity_id, cnt, blocks, block, seen)``, a row
    per ticket and block of the team with those of the block who have a marker, and ``(block, team)``, the members (owner_id, times) of each of the ``blocks``.

    ``cnt`` and ``times`` count rows of a ticket and of a member. The pairs are as many as the job has; in this form they are not yet rows, and no task holds
    more than a ticket and a block at once.
    """
    team = user_dir.where(F.col("domain_id") == support_domain).groupBy(F.col("id").alias("owner_id")).agg(F.count(F.lit(1)).alias("times"))
    blocks = team.agg(F.greatest(F.ceil(F.count(F.lit(1)) / TEAM_BLOCK), F.lit(1)).cast("int").alias("blocks"))
    placed = team.withColumn("blocks", blocks.scalar()).select("owner_id", "times", _block_of().alias("block"))
    open_ = ticket.where("last_sys_id > 0").groupBy("ticket_id").agg(F.count(F.lit(1)).alias("cnt")).withColumn("blocks", blocks.scalar())
    seen = read_ticket.select("ticket_id", F.col("uid").alias("owner_id")).join(placed.select("owner_id", "block"), "owner_id").groupBy("ticket_id", "block").agg(F.collect_set("owner_id").alias("seen"))
    cells = open_.select("ticket_id", "cnt", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).join(seen, ["ticket_id", "block"], "left")
    members = placed.groupBy("block").agg(F.collect_list(F.struct("owner_id", "times")).alias("team"))
    return cells.select(F.col("ticket_id").cast("string").alias("entity_id"), "cnt", "blocks", "block", "seen"), members


def _block_of() -> Column:
    return F.pmod(F.xxhash64("owner_id"), F.col("blocks")).cast("int")


def _among(names: str, name: Column) -> Column:
    """Whether ``name`` is in the list; NULL is in none, and nothing is in no list."""
    return F.coalesce(F.array_contains(names, name), F.lit(False))


def notification_items(
    contact: DataFrame, user_dir: DataFrame, channel: DataFrame, read_channel: DataFrame, rooms: DataFrame, team_channel: DataFrame,
    team_read: DataFrame, hub_media: DataFrame, ticket: DataFrame, read_ticket: DataFrame, support_domain: int = 0,
    cleared: DataFrame | None = None, unmarked: bool = True,
) -> DataFrame:
    """The feed before grouping.  Team messages and files arrive counted per (member, room), all else one row each.

    ``rooms(owner_id, hub_id, area)`` are the rooms on each desk outside the guest area, ``cleared`` the file markers as in ``new_files``,
    ``unmarked`` as in ``ticket_items``.
    """
    one = F.lit(1).cast("bigint")
    null = F.lit(None).cast("string")
    people = user_dir.select(F.col("id").alias("entity"))
    invites = contact.where(F.col("status").isin(*PENDING)).join(people, "entity", "left_semi").select(
        "owner_id", F.col("id").alias("resource_id"), F.col("entity").alias("entity_id"), F.col("owner_id").alias("hub_id"),
        F.col("mtime").alias("ctime"), F.lit("personal").alias("area"), F.lit("contact").alias("category"), one.alias("cnt"))
    known = contact.where("uid IS NOT NULL").select("owner_id", F.col("uid").alias("entity_id")).distinct()
    chats = unread_items(channel, read_channel).join(known, ["owner_id", "entity_id"]).select(
        "owner_id", F.col("message_id").alias("resource_id"), F.col("author_id").alias("entity_id"), F.col("owner_id").alias("hub_id"), "ctime",
        F.lit("personal").alias("area"), F.lit("chat").alias("category"), one.alias("cnt"))
    desk = rooms.select("hub_id", F.col("owner_id").alias("uid"), "area")

    def room_items(rows: DataFrame, category: str) -> DataFrame:
        return rows.join(desk, ["hub_id", "uid"]).select(
            F.col("uid").alias("owner_id"), null.alias("resource_id"), F.col("hub_id").alias("entity_id"), "hub_id", "ctime", "area",
            F.lit(category).alias("category"), "cnt")

    team = room_items(team_pending(team_channel, team_read), "teamchat")
    files = room_items(new_files(hub_media, desk, cleared), "media")
    tickets = ticket_items(ticket, read_ticket, user_dir, support_domain, unmarked).select(
        "owner_id", F.col("entity_id").alias("resource_id"), "entity_id", F.lit(TICKETS).alias("hub_id"), "ctime", F.lit("personal").alias("area"),
        F.lit("ticket").alias("category"), "cnt")
    out = invites
    for branch in (chats, team, files, tickets):
        out = out.unionByName(branch)
    return out.select(*ITEM)


def notification_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("owner_id", "entity_id", "hub_id", "category", "area").agg(F.sum("cnt").alias("cnt"), F.max("ctime").alias("ctime"))


def contact_of_key(contact: DataFrame, *more: str) -> DataFrame:
    """The owner's contact for a user id: uid match first, then entity, then the smallest ``sys_id``; with ``more`` of its columns."""
    keys = contact.select(
        "owner_id", "id", "firstname", "lastname", "surname", "status", "sys_id", *more,
        F.explode(F.array(F.struct(F.col("uid").alias("k"), F.lit(0).alias("p")), F.struct(F.col("entity").alias("k"), F.lit(1).alias("p")))).alias("x"))
    row = F.struct("id", "firstname", "lastname", "surname", "status", *more)
    return keys.where("x.k IS NOT NULL").groupBy("owner_id", F.col("x.k").alias("entity_id")).agg(
        F.min_by(row, F.struct("x.p", "sys_id")).alias("c"))


def notification_center(
    items: DataFrame, contact: DataFrame, contact_email: DataFrame, user_dir: DataFrame, hub: DataFrame, map_tag: DataFrame, tag: DataFrame,
    unmarked: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """Counts per owner, entity, room, category and area, with names and the tags of the contact or room.

    The tag list is put together once per key, in parts of bounded length (``part`` = 1 for all usual keys).
    ``unmarked`` of ``unmarked_tickets`` are further tickets, a row each; they become rows last of all and are shuffled by ticket and block only,
    but for those that an owner has made a contact or has tagged.
    """
    d = user_dir.select(F.col("id").alias("entity_id"), F.col("id").alias("user_id"), F.col("email").alias("d_email"),
                        F.col("firstname").alias("d_first"), F.col("lastname").alias("d_last"))
    h = hub.select(F.col("id").alias("hub_id"), F.col("name").alias("h_name"))
    # the contacts take their e-mails, so that the counts, of which there are more, need not be shuffled for it
    people = contact_of_key(contact.join(default_email(contact_email), ["owner_id", "id"], "left"), "ce_email")
    labels = map_tag.join(tag.select("tag_id"), "tag_id", "left_semi").select("owner_id", F.col("id").alias("key_id"), "tag_id", F.xxhash64("tag_id").alias("o")).distinct()
    tags = list_in_parts(labels, ["owner_id", "key_id"], "o", F.col("tag_id"), "tags").select("owner_id", "key_id", "part", F.array_join("tags", ",").alias("tag_id"))
    ticket = F.col("hub_id") == TICKETS
    if unmarked is not None:
        cells, team = unmarked
        about = people.select("owner_id", "entity_id").unionByName(tags.select("owner_id", F.col("key_id").alias("entity_id")))
        about = about.join(cells.select("entity_id", "blocks").distinct(), "entity_id").groupBy("entity_id", _block_of().alias("block")).agg(F.collect_set("owner_id").alias("known"))
        pending = cells.join(about, ["entity_id", "block"], "left")

        def pairs(rows: DataFrame, known: bool, *columns: str) -> DataFrame:
            some = F.filter("team", lambda x: ~_among("seen", x["owner_id"]) & (_among("known", x["owner_id"]) == F.lit(known)))
            return rows.join(team, "block").select("entity_id", "cnt", *columns, F.explode(some).alias("o")).select(
                "o.owner_id", "entity_id", F.lit(TICKETS).alias("hub_id"), F.lit(None).cast("bigint").alias("ctime"), F.lit("personal").alias("area"), F.lit("ticket").alias("category"),
                (F.col("cnt") * F.col("o.times")).alias("cnt"), *columns)

        items = items.unionByName(pairs(pending.where("known IS NOT NULL"), True).withColumn("resource_id", F.col("entity_id")).select(*ITEM))
    b = notification_counts(items)
    shown = (
        b.join(d, "entity_id", "left").join(people, ["owner_id", "entity_id"], "left").join(h, "hub_id", "left")
        .withColumns({"contact_id": F.col("c.id"), "ce_email": F.col("c.ce_email")})
        .withColumn("key_id", F.coalesce("contact_id", "user_id", F.when(ticket, F.col("entity_id")).otherwise(F.col("hub_id"))))
    )
    name = F.coalesce(X.display_name("c.surname", "c.firstname", "c.lastname", "ce_email", "d_email"), "h_name")
    has_person = F.coalesce("contact_id", "user_id").isNotNull()
    out = shown.join(tags, ["owner_id", "key_id"], "left").select(
        "owner_id", "contact_id", "user_id", "key_id", F.coalesce("c.firstname", "d_first").alias("firstname"), F.coalesce("c.lastname", "d_last").alias("lastname"),
        F.when(ticket, F.col("entity_id")).when(has_person, name).otherwise(F.col("h_name")).alias("surname"),
        F.coalesce("ce_email", "d_email").alias("email"), F.col("c.status").alias("status"), "hub_id", "ctime", "category", "cnt", "area", "tag_id",
        F.coalesce("part", F.lit(1).cast("bigint")).alias("part"))
    if unmarked is None:
        return out
    none = F.lit(None).cast("string")
    listed = pairs(pending.join(d, "entity_id", "left"), False, "user_id", "d_email", "d_first", "d_last")
    return out.unionByName(listed.select(
        "owner_id", none.alias("contact_id"), "user_id", F.col("entity_id").alias("key_id"), F.col("d_first").alias("firstname"), F.col("d_last").alias("lastname"),
        F.col("entity_id").alias("surname"), F.col("d_email").alias("email"), none.alias("status"), "hub_id", "ctime", "category", "cnt", "area", none.alias("tag_id"),
        F.lit(1).cast("bigint").alias("part")))


def notification_entity(items: DataFrame, rooms: DataFrame, user_dir: DataFrame) -> DataFrame:
    """The same per inbox or room, with an ``empty`` row of count 0 where nothing is pending.

    Team chat counts only in private rooms, files only outside the personal area.
    """
    kept = items.where("category <> 'teamchat' OR area = 'private'").where("category <> 'media' OR area <> 'personal'")
    tenant = F.when(F.col("area") == "personal", F.col("owner_id")).otherwise(F.col("hub_id"))
    counts = notification_counts(kept).withColumn("tenant_id", tenant).drop("area")
    tenants = user_dir.select(F.col("id").alias("owner_id"), F.col("id").alias("tenant_id"), F.lit("personal").alias("area")).unionByName(
        rooms.select("owner_id", F.col("hub_id").alias("tenant_id"), "area"))
    return tenants.join(counts, ["owner_id", "tenant_id"], "left").select(
        "owner_id", "tenant_id", F.coalesce("entity_id", "tenant_id").alias("entity_id"), F.coalesce("hub_id", "tenant_id").alias("hub_id"), "area",
        F.coalesce("category", F.lit("empty")).alias("category"), F.coalesce("cnt", F.lit(0)).alias("cnt"),
        F.when(F.col("category").isNull(), F.lit(0)).otherwise(F.col("ctime")).alias("ctime"))


def action_log_feed(action_log: DataFrame, members: DataFrame, user_dir: DataFrame, page: int | None = 1, rows: int = 45) -> DataFrame:
    """Newest events of every member: for everybody, for me, and for admins if I am one; with ``page`` None all events of every member.

    The page of a member is within the latest events of each audience, so a room's shared events are cut to
    the page before they meet its members.
    """
    whole, page = page is None, max(page or 1, 1)
    k = page * rows
    order = [F.col("ctime").desc(), F.col("sys_id").desc()]
    names = user_dir.select(F.col("id").alias("uid"), "firstname", "lastname")
    text = F.when(F.col("category") == "media", F.concat("log", F.lit(" by "), "firstname", F.lit(" "), "lastname")).otherwise(F.col("log"))
    events = action_log.join(names, "uid").select("hub_id", "sys_id", "notify_to", "entity_id", "category", text.alias("log"), "ctime")
    people = members.select("hub_id", F.col("uid").alias("viewer"), "permission")

    def shared(audience: str, viewers: DataFrame) -> DataFrame:
        latest = events.where(F.col("notify_to") == audience)
        latest = latest if whole else top_in_groups(latest, ["hub_id"], order, k, "_place").drop("_place")
        return latest.join(viewers.select("hub_id", "viewer"), "hub_id")

    mine = events.where("notify_to = 'member'").withColumn("viewer", F.col("entity_id")).join(people.select("hub_id", "viewer"), ["hub_id", "viewer"], "left_semi")
    admins = people.where(X.has_bit("permission", X.ADMIN_BIT))
    cols = ["hub_id", "viewer", "sys_id", "category", "log", "ctime"]
    feed = shared("all", people).select(*cols).unionByName(shared("admin", admins).select(*cols)).unionByName(mine.select(*cols))
    return feed if whole else paginate(feed, ["hub_id", "viewer"], order, page, rows)


def backup_log(action_log: DataFrame, page: int | None = 1, rows: int = 45) -> DataFrame:
    """Backups of every room, oldest first; ``page`` None is all of them."""
    kept = action_log.where("action = 'backup'").select("hub_id", "sys_id", "uid", "category", "log", "ctime")
    return kept if page is None else paginate(kept, ["hub_id"], [F.col("ctime").asc(), F.col("sys_id").asc()], page, rows)


def login_history(login_log: DataFrame, cookie: DataFrame, page: int | None = None, rows: int = 45) -> DataFrame:
    """Sign-ins with place and address from their JSON; active while the cookie still belongs to the user."""
    live = cookie.select(F.col("id").alias("cookie_id"), F.col("uid").alias("owner_id")).distinct().withColumn("live", F.lit(1))
    out = login_log.where("intime IS NOT NULL").join(live, ["cookie_id", "owner_id"], "left").select(
        "owner_id", "sys_id", "cookie_id", "intime", "outtime", F.get_json_object("metadata", "$.timezone").alias("timezone"),
        F.get_json_object("metadata", "$.city").alias("city"), F.get_json_object("metadata", "$.ip").alias("ip"),
        F.when(F.col("live").isNull(), F.lit("inactive")).otherwise(F.lit("active")).alias("status"))
    return out if page is None else paginate(out, ["owner_id"], [F.col("sys_id").desc()], page, rows)


def mark_unread(mark: DataFrame, per_conversation: bool = True) -> DataFrame:
    keys = ["owner_id", "conversation_id"] if per_conversation else ["owner_id"]
    return mark.where("status = 'new'").groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))
