"""Contact lists, searches and cards, computed for every owner at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlor.functions import expr as X
from parlor.plans.skew import list_in_parts, paginate

KEY = ["owner_id", "id"]


def default_email(contact_email: DataFrame) -> DataFrame:
    """``(owner_id, id, ce_email)``: the default e-mail of each contact."""
    return (
        contact_email.where("is_default = 1")
        .groupBy("owner_id", F.col("contact_id").alias("id"))
        .agg(F.min_by("email", "sys_id").alias("ce_email"))
    )


def directory(user_dir: DataFrame, prefix: str, *columns: str) -> DataFrame:
    return user_dir.select(*[F.col(c).alias(f"{prefix}_{c}") for c in ("id", *columns)])


def blocked_by_me(contact_block: DataFrame) -> DataFrame:
    """``(owner_id, id)`` of contacts with a block row of their owner."""
    return contact_block.select("owner_id", F.col("contact_id").alias("id")).distinct()


def blocked_me(blockers: DataFrame, contact_block: DataFrame, user_dir: DataFrame) -> DataFrame:
    """``(owner_id, id)`` of contacts that block their owner.

    ``blockers(owner_id, id, blocker)``: the users a contact may stand for.  A block names its target by uid,
    entity id or e-mail; e-mails are turned into ids first, and the two OR conditions become one equi-join.
    """
    named = contact_block.select(F.col("owner_id").alias("blocker"), F.explode(F.array("uid", "entity")).alias("named"))
    by_mail = user_dir.select(F.col("email").alias("named"), F.col("id").alias("named_id"))
    targets = (
        named.where(F.col("named").isNotNull()).join(by_mail, "named", "left")
        .select("blocker", F.coalesce("named_id", "named").alias("owner_id")).distinct()
    )
    return blockers.join(targets, ["blocker", "owner_id"], "left_semi").select(*KEY).distinct()


def block_flags(contact: DataFrame, contact_email: DataFrame, user_dir: DataFrame, contact_block: DataFrame) -> DataFrame:
    """Every contact with ``is_blocked`` and ``is_blocked_me`` (at most one row per contact).

    Several matching block rows count once.
    """
    dm = user_dir.select(F.col("email").alias("ce_email"), F.col("id").alias("dm_id"))
    keys = contact.select(*KEY, "entity").join(default_email(contact_email), KEY, "left").join(dm, "ce_email", "left")
    blockers = keys.select(*KEY, F.explode(F.array("entity", "dm_id")).alias("blocker")).where("blocker IS NOT NULL")
    return _flags(contact.select(*KEY), blockers, contact_block, user_dir)


def _flags(keys: DataFrame, blockers: DataFrame, contact_block: DataFrame, user_dir: DataFrame) -> DataFrame:
    mine = blocked_by_me(contact_block).withColumn("_mine", F.lit(1))
    his = blocked_me(blockers, contact_block, user_dir).withColumn("_his", F.lit(1))
    return (
        keys.join(mine, KEY, "left").join(his, KEY, "left")
        .select(*keys.columns, F.coalesce("_mine", F.lit(0)).alias("is_blocked"), F.coalesce("_his", F.lit(0)).alias("is_blocked_me"))
    )


def uid_flags(contact: DataFrame, contact_block: DataFrame, user_dir: DataFrame) -> DataFrame:
    """The variant of the room lists: the contact stands for its entity or its uid."""
    blockers = contact.select(*KEY, F.explode(F.array("entity", "uid")).alias("blocker")).where("blocker IS NOT NULL")
    return _flags(contact.select(*KEY), blockers, contact_block, user_dir)


def archived_keys(archive_entity: DataFrame, name: str = "id") -> DataFrame:
    return archive_entity.select("owner_id", F.col("entity_id").alias(name)).distinct().withColumn("is_archived", F.lit(1))


def archived_option(contact: DataFrame, archive_entity: DataFrame, option: str = "active") -> DataFrame:
    """``archived``/``active`` by presence in the archive table; ``sent`` looks at the contact status instead."""
    if option == "sent":
        return contact.where(F.col("status") == "sent")
    keys = archived_keys(archive_entity).select(*KEY)
    return contact.join(keys, KEY, "left_semi" if option == "archived" else "left_anti")


def _star(contact: DataFrame, contact_email: DataFrame, user_dir: DataFrame, contact_block: DataFrame) -> DataFrame:
    """Contact with default e-mail, directory rows by entity and by uid, and block flags."""
    de = directory(user_dir, "de", "email")
    du = directory(user_dir, "du", "email", "username", "connected", "domain_id")
    return (
        contact.join(default_email(contact_email), KEY, "left")
        .join(de, F.col("entity") == F.col("de_id"), "left")
        .join(du, F.col("uid") == F.col("du_id"), "left")
        .join(block_flags(contact, contact_email, user_dir, contact_block), KEY, "left")
        .withColumn("display", X.display_name("surname", "firstname", "lastname", "ce_email", "de_email"))
    )


def sort_columns(sort_by: str, order: str, date: Column, name: Column) -> list[Column]:
    """NULL first ascending, last descending, as both engines of the model do by default."""
    key = {"date": date, "name": name}.get(sort_by.lower())
    if key is None:
        return []
    return [key.asc_nulls_first() if order.lower() == "asc" else key.desc_nulls_last()]


def contact_list(
    contact: DataFrame, contact_email: DataFrame, user_dir: DataFrame, socket: DataFrame, contact_block: DataFrame,
    archive_entity: DataFrame, tagged: DataFrame | None = None, sort_by: str = "date", order: str = "desc",
    option: str = "active", page: int | None = None, rows: int = 45,
) -> DataFrame:
    """Contacts per owner without those still ``received``; ``tagged(owner_id, id)`` restricts to a tag subtree."""
    kept = contact.where("status <> 'received'")
    if tagged is not None:
        kept = kept.join(tagged.select(*KEY), KEY, "left_semi")
    kept = archived_option(kept, archive_entity, option)
    online = socket.where("state = 'active'").select(F.col("uid").alias("s_uid")).distinct()
    out = (
        _star(kept, contact_email, user_dir, contact_block)
        .join(online, F.col("entity") == F.col("s_uid"), "left")
        .join(archived_keys(archive_entity), KEY, "left")
        .select(
            "owner_id", "sys_id", "id", F.lit(1).alias("is_mycontact"), F.lit("my_contact").alias("type"), "firstname", "lastname",
            "ctime", "entity", F.col("display").alias("surname"), F.col("surname").alias("given_surname"),
            F.when(F.col("s_uid").isNull(), F.lit(0)).otherwise(F.col("du_connected")).alias("online"),
            X.flag(F.col("de_id").isNotNull()).alias("is_user"), F.col("du_username").alias("username"), "status",
            F.lit(1).alias("is_need_email"), "is_blocked", "is_blocked_me", F.coalesce("is_archived", F.lit(0)).alias("is_archived"),
        )
    )
    if page is not None:
        by = sort_columns(sort_by, order, F.col("ctime"), F.col("surname"))
        out = paginate(out, ["owner_id"], [*by, F.col("sys_id").asc()], page, rows)
    return out.drop("sys_id")


def _search_rows(contact: DataFrame, contact_email: DataFrame, user_dir: DataFrame, contact_block: DataFrame) -> DataFrame:
    return _star(contact, contact_email, user_dir, contact_block).select(
        "owner_id", F.col("id").alias("contact_id"), F.lit(1).alias("is_mycontact"),
        F.coalesce("du_id", "de_id", "entity").alias("id"), F.coalesce("du_email", "de_email", "ce_email").alias("email"),
        "firstname", "lastname", X.full_name("firstname", "lastname").alias("fullname"), F.col("display").alias("surname"),
        X.flag(F.col("uid").isNotNull()).alias("is_user"), X.flag(F.col("du_id").isNull()).alias("is_need_email"),
        "status", "is_blocked", "is_blocked_me",
    )


def contact_search(
    contact: DataFrame, contact_email: DataFrame, user_dir: DataFrame, contact_block: DataFrame, key: str,
    page: int | None = None, rows: int = 45,
) -> DataFrame:
    kept = contact.where("status <> 'received'").where(X.any_starts_with(["firstname", "lastname", "surname", "source"], key))
    out = _search_rows(kept, contact_email, user_dir, contact_block)
    if page is not None:
        out = paginate(out, ["owner_id"], [F.col("surname").asc(), F.col("contact_id").asc()], page, rows)
    return out


def contact_search_domain(
    contact: DataFrame, contact_email: DataFrame, user_dir: DataFrame, contact_block: DataFrame, key: str,
    page: int | None = None, rows: int = 45,
) -> DataFrame:
    kept = contact.where("status <> 'received'").where(
        X.any_starts_with(["firstname", "lastname", "surname", F.coalesce("firstname", "lastname", "source")], key)
    )
    out = _star(kept, contact_email, user_dir, contact_block).select(
        "owner_id", F.lit(1).alias("is_mycontact"), F.lit("my_contact").alias("type"), "id",
        F.when(F.coalesce("firstname", "lastname").isNull(), F.coalesce("ce_email", "de_email")).alias("email"),
        F.col("display").alias("surname"), F.col("surname").alias("given_surname"), "firstname", "lastname",
        X.full_name("firstname", "lastname").alias("fullname"), X.flag(F.col("uid").isNotNull()).alias("is_user"),
        F.lit(1).alias("is_need_email"), "status", "is_blocked", "is_blocked_me",
    )
    if page is not None:
        out = paginate(out, ["owner_id"], [F.col("fullname").asc(), F.col("id").asc()], page, rows)
    return out


def contact_pick(
    contact: DataFrame, contact_email: DataFrame, user_dir: DataFrame, contact_block: DataFrame, key: str, status: str,
    without: DataFrame,
) -> DataFrame:
    """``active`` contacts or all others (``paper``), minus ``without(email)``; rows without e-mail never match."""
    active = F.col("status") == "active"
    kept = contact.where(active if status == "active" else ~active)
    found = contact_search(kept, contact_email, user_dir, contact_block, key)
    return found.where("email IS NOT NULL").join(without.select("email").distinct(), "email", "left_anti")


def contact_card(
    contact: DataFrame, contact_email: DataFrame, contact_phone: DataFrame, contact_address: DataFrame,
    map_tag: DataFrame, tag: DataFrame, user_dir: DataFrame, contact_block: DataFrame, archive_entity: DataFrame,
) -> DataFrame:
    """Contact detail with ordered arrays of e-mails, phones, addresses and tags.

    The arrays are built side by side in parts of bounded length: a usual contact is the one row with
    ``part = 1``; only a contact with more children than a part holds gets further rows.
    """
    head = (
        _star(contact, contact_email, user_dir, contact_block)
        .join(archived_keys(archive_entity), KEY, "left")
        .select(
            *KEY, "entity", "firstname", "lastname", "ctime", "mtime", "uid", "status", "source",
            F.coalesce("du_connected", F.lit(-1)).alias("connected"), F.col("du_username").alias("username"),
            F.col("du_domain_id").alias("domain_id"), X.flag(F.col("de_id").isNotNull()).alias("is_user"),
            F.col("display").alias("surname"), F.col("surname").alias("given_surname"), F.lit(1).alias("is_need_email"),
            "is_blocked", "is_blocked_me", F.coalesce("is_archived", F.lit(0)).alias("is_archived"),
        )
    )
    address = contact_address.select(
        "owner_id", F.col("contact_id").alias("id"), "sys_id",
        F.to_json(F.struct("id", F.get_json_object("address", "$.street").alias("street"),
                           F.get_json_object("address", "$.city").alias("city"),
                           F.get_json_object("address", "$.country").alias("country"), "category")).alias("item"),
    )
    mail = contact_email.select("owner_id", F.col("contact_id").alias("id"), "sys_id",
                                F.to_json(F.struct("id", "email", "category", "is_default")).alias("item"))
    phone = contact_phone.select("owner_id", F.col("contact_id").alias("id"), "sys_id",
                                 F.to_json(F.struct("id", "areacode", "phone", "category")).alias("item"))
    # a tag's own number orders it; ids are turned into one
    labels = map_tag.join(tag.select("tag_id", "position", "name"), "tag_id").select(
        "owner_id", "id", F.xxhash64("tag_id").alias("sys_id"), F.to_json(F.struct("tag_id", "name", "position")).alias("item"))
    sections = {"emails": mail, "phones": phone, "addresses": address, "tags": labels}
    items = None
    for name, rows in sections.items():
        rows = rows.withColumn("section", F.lit(name))
        items = rows if items is None else items.unionByName(rows)
    lists = list_in_parts(items, [*KEY, "section"], "sys_id", F.col("item"), "items")
    wide = lists.groupBy(*KEY, "part").agg(
        *[F.max(F.when(F.col("section") == n, F.col("items"))).alias(n) for n in sections]
    )
    empty = F.array().cast("array<string>")
    return (
        head.join(wide, KEY, "left").withColumn("part", F.coalesce("part", F.lit(1).cast("bigint")))
        .select(*head.columns, "part", *[F.to_json(F.coalesce(F.col(n), empty)).alias(n) for n in sections])
    )


def same_name(contact: DataFrame, requests: DataFrame) -> DataFrame:
    """Another contact of the owner with the same full name: ``requests(owner_id, id, key)``; smallest ``sys_id`` wins."""
    named = contact.select("owner_id", F.concat("firstname", F.lit(" "), "lastname").alias("key"), F.col("id").alias("contact_id"), "sys_id")
    return (
        requests.join(named, ["owner_id", "key"]).where(F.col("id") != F.col("contact_id"))
        .groupBy("owner_id", "id").agg(F.min_by("contact_id", "sys_id").alias("contact_id"))
    )


def presence(contact: DataFrame, socket: DataFrame, user_dir: DataFrame) -> DataFrame:
    """One row per owner and online contact, names falling back to the directory."""
    online = socket.where("state = 'active'").select("uid").distinct()
    names = user_dir.select(F.col("id").alias("uid"), "connected", F.col("firstname").alias("d_first"), F.col("lastname").alias("d_last"))
    return (
        contact.join(online, "uid", "left_semi").join(names, "uid")
        .groupBy("owner_id", "uid", F.col("connected").alias("status"))
        .agg(
            F.min_by(F.coalesce("firstname", "d_first"), "sys_id").alias("firstname"),
            F.min_by(F.coalesce("lastname", "d_last"), "sys_id").alias("lastname"),
        )
    )


def presence_on_server(contact: DataFrame, socket: DataFrame, server: str | None = None) -> DataFrame:
    live = socket.where("state = 'active'")
    if server is not None:
        live = live.where(F.col("server") == server)
    return contact.select("owner_id", "uid", "firstname").join(live.select("uid", F.col("id").alias("socket_id"), "server"), "uid")


def contact_duplicates(contact: DataFrame, candidates: DataFrame) -> DataFrame:
    """``candidates(row_no, owner_id, entity, firstname, lastname, contact_id)`` with the contact already there.

    By entity, or by first and last name when both are given; never the candidate itself.
    """
    mine = contact.select("owner_id", "entity", "firstname", "lastname", "sys_id", F.col("id").alias("found"))
    other = F.col("contact_id").isNull() | (F.col("found") != F.col("contact_id"))
    asked = candidates.select("row_no", "owner_id", "contact_id", "entity", "firstname", "lastname")
    by_entity = asked.join(mine.select("owner_id", "entity", "sys_id", "found"), ["owner_id", "entity"])
    by_name = asked.join(mine.select("owner_id", "firstname", "lastname", "sys_id", "found"), ["owner_id", "firstname", "lastname"])
    both = by_entity.select("row_no", "contact_id", "sys_id", "found", F.lit("entity").alias("found_by")).unionByName(
        by_name.select("row_no", "contact_id", "sys_id", "found", F.lit("name").alias("found_by")))
    return both.where(other).groupBy("row_no", "found_by").agg(F.min_by("found", "sys_id").alias("contact_id"))


def resolve_identity(keys: DataFrame, user_dir: DataFrame) -> DataFrame:
    """``keys(key)`` is an id or an e-mail; gives ``(key, id, email)``."""
    by_id = user_dir.select(F.col("id").alias("key"), F.col("id").alias("i_id"), F.col("email").alias("i_mail"))
    by_mail = user_dir.select(F.col("email").alias("key"), F.col("id").alias("m_id"), F.col("email").alias("m_mail"))
    return (
        keys.select("key").distinct().join(by_id, "key", "left").join(by_mail, "key", "left")
        .select("key", F.coalesce("i_id", "m_id").alias("id"), F.coalesce("i_mail", "m_mail").alias("email"))
    )


def contacts_of_identity(keys: DataFrame, user_dir: DataFrame, contact: DataFrame) -> DataFrame:
    """Contacts whose entity or uid is the key or the key's e-mail."""
    known = resolve_identity(keys, user_dir)
    names = known.select("key", F.explode(F.array("key", "email")).alias("name")).where("name IS NOT NULL").distinct()
    rows = contact.select("owner_id", "id", "status", F.explode(F.array_distinct(F.array("entity", "uid"))).alias("name")).where("name IS NOT NULL")
    return names.join(rows, "name").select("key", "owner_id", "id", "status").distinct()


def room_contact(
    pairs: DataFrame, contact: DataFrame, contact_email: DataFrame, user_dir: DataFrame, contact_block: DataFrame
) -> DataFrame:
    """``pairs(owner_id, user_id)``: a directory user as the owner's contact list shows them; the contact may be absent."""
    du = user_dir.select(F.col("id").alias("user_id"), F.col("email").alias("du_email"))
    mine = (
        contact.join(default_email(contact_email), KEY, "left").join(uid_flags(contact, contact_block, user_dir), KEY, "left")
        .select("owner_id", F.col("entity").alias("user_id"), F.col("id").alias("contact_id"), "firstname", "lastname", "surname",
                "ce_email", "is_blocked", "is_blocked_me")
    )
    return (
        pairs.select("owner_id", "user_id").distinct().join(du, "user_id").join(mine, ["owner_id", "user_id"], "left")
        .select(
            "owner_id", "user_id", "contact_id", "firstname", "lastname",
            X.display_name("surname", "firstname", "lastname", "ce_email", "du_email").alias("surname"),
            F.coalesce("is_blocked", F.lit(0)).alias("is_blocked"), F.coalesce("is_blocked_me", F.lit(0)).alias("is_blocked_me"),
        )
    )


def blacklist_show(blacklist: DataFrame, user_dir: DataFrame, page: int | None = 1, rows: int = 45) -> DataFrame:
    """Blocked users by e-mail; ``page`` None is the whole list."""
    listed = blacklist.join(user_dir.select("id", "email", "profile"), "email").select(
        "owner_id", "id", "email", F.get_json_object("profile", "$.firstname").alias("firstname"),
        F.get_json_object("profile", "$.lastname").alias("lastname"), F.get_json_object("profile", "$.mobile").alias("mobile"))
    return listed if page is None else paginate(listed, ["owner_id"], [F.concat("firstname", F.lit(" "), "lastname").asc(), F.col("email").asc()], page, rows)


PENDING: Sequence[str] = ("received", "informed", "invitation")


def invite_notifications(contact: DataFrame, user_dir: DataFrame) -> DataFrame:
    people = user_dir.select(F.col("id").alias("entity"), F.col("id").alias("user_id"), "email", F.col("fullname").alias("d_fullname"))
    auto = F.get_json_object("metadata", "$.is_auto") == "1"
    first, last = F.coalesce("firstname", F.lit("")), F.coalesce("lastname", F.lit(""))
    return contact.where(F.col("status").isin(*PENDING)).join(people, "entity").select(
        "owner_id", F.col("id").alias("contact_id"), "user_id", "email", first.alias("firstname"), last.alias("lastname"), "message", "status",
        F.when(auto, F.col("d_fullname")).otherwise(F.trim(X.full_name("firstname", "lastname"))).alias("fullname"))


def invite_count(contact: DataFrame, user_dir: DataFrame) -> DataFrame:
    return invite_notifications(contact, user_dir).groupBy("owner_id").agg(F.count(F.lit(1)).alias("count"))


def contact_export(
    contact: DataFrame, contact_email: DataFrame, contact_phone: DataFrame, contact_address: DataFrame, user_dir: DataFrame,
    host: str = "https://d",
) -> DataFrame:
    """One row per contact e-mail; phones and addresses as ``value---WORK`` joined by ``:::``.

    Each child table is put together on its own, so values do not repeat; the last name falls back to the directory.
    Lists longer than a part go on in the row with the next ``part``.
    """
    place = F.when(F.col("category") == "prof", F.lit("WORK")).otherwise(F.lit("HOME"))

    def joined(rows: DataFrame, column: str) -> DataFrame:
        tagged = rows.select("owner_id", "contact_id", "sys_id", F.concat(F.col(column), F.lit("---"), place).alias("v"))
        return list_in_parts(tagged, ["owner_id", "contact_id"], "sys_id", F.col("v"), column).withColumn(column, F.concat_ws(":::", column))

    lists = joined(contact_phone, "phone").join(joined(contact_address, "address"), ["owner_id", "contact_id", "part"], "full")
    m = user_dir.select("email", F.col("id").alias("m_id"), F.col("firstname").alias("m_first"), F.col("lastname").alias("m_last"), "domain_id")
    first, last = F.coalesce("firstname", "m_first"), F.coalesce("lastname", "m_last")
    return (
        contact_email.where("email IS NOT NULL").select("owner_id", "contact_id", "email", "is_default", F.col("sys_id").alias("e_sys"))
        .groupBy("owner_id", "email").agg(F.min_by(F.struct("contact_id", "is_default"), "e_sys").alias("e"))
        .select("owner_id", "email", "e.contact_id", "e.is_default")
        .join(contact.select("owner_id", F.col("id").alias("contact_id"), "firstname", "lastname", "surname"), ["owner_id", "contact_id"])
        .join(m, "email", "left")
        .join(lists, ["owner_id", "contact_id"], "left")
        .select(
            "owner_id", "contact_id", "email", "is_default", first.alias("firstname"), last.alias("lastname"), "surname",
            F.concat(F.lit(host), F.col("domain_id").cast("string"), F.lit("/avatar/"), F.col("m_id")).alias("avatar"),
            X.full_name(first, last).alias("fullname"), "phone", "address", F.coalesce("part", F.lit(1).cast("bigint")).alias("part"),
        )
    )

