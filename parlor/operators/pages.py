"""Pages and their revisions, languages, content tags, names and ad-hoc table queries."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlor.functions import expr as X
from parlor.operators.search import prefix_lookup
from parlor.plans.skew import PAGE_ROWS, count_upto, list_in_parts, paginate, rank_in_groups, top_in_groups

PAGE = ["master_id", "lang"]


def revision_number(history: DataFrame) -> DataFrame:
    """``v1, v2, …`` per page in the order of ``serial``."""
    return rank_in_groups(history.select("master_id", "serial"), ["master_id"], "serial", "_n").select(
        "serial", "master_id", F.concat(F.lit("v"), F.col("_n").cast("string")).alias("version"))


def current_revision(history: DataFrame) -> DataFrame:
    """Status and online mark of every revision, re-derived: per page and language the latest is the draft, the last
    one put online stays online, and the page's active revision is its latest.
    """
    latest = history.groupBy(*PAGE).agg(F.max("serial").alias("draft_id"), F.max(F.when(F.col("isonline") == 1, F.col("serial"))).alias("online_id"))
    active = history.groupBy("master_id").agg(F.max("serial").alias("active"))
    return history.join(latest, PAGE).join(active, "master_id").select(
        "serial", *PAGE, F.when(F.col("serial") == F.col("draft_id"), F.lit("draft")).otherwise(F.lit("history")).alias("status"),
        X.flag(F.col("serial") == F.col("online_id")).alias("isonline"), "active")


def published_filter(history: DataFrame, mode: int) -> DataFrame:
    """0 drafts, 1 online, 2 both."""
    draft, online = F.col("status") == "draft", F.col("isonline") == 1
    return history.where({0: draft, 1: online, 2: draft | online}[mode])


def next_version(requests: DataFrame, block: DataFrame) -> DataFrame:
    """``requests(seq, base)`` to the next free ``base-vN``: N follows the largest whole number in use.

    Copies of one base in a batch count on from each other.
    """
    used = block.select(
        F.regexp_extract("hashtag", r"^(.*)-v([0-9]+)$", 1).alias("base"),
        F.regexp_extract("hashtag", r"^(.*)-v([0-9]+)$", 2).try_cast("bigint").alias("n")).where("n IS NOT NULL")
    top = used.groupBy("base").agg(F.max("n").alias("top"))
    nth = rank_in_groups(requests.select("seq", "base"), ["base"], "seq", "_k")
    return nth.join(top, "base", "left").select(
        "seq", F.concat("base", F.lit("-v"), (F.coalesce("top", F.lit(-1)) + F.col("_k")).cast("string")).alias("hashtag"))


def unique_names(existing: DataFrame, wanted: DataFrame, keys: Sequence[str], gap: str = " ") -> DataFrame:
    """``wanted(keys, seq, name)`` to names not taken in ``existing(keys, name)``: the name itself or ``name (n)``
    with the smallest free n.

    Free literal names are given out first (smallest ``seq`` per name); every later request k of a name takes its
    k-th free number, found by counting the taken numbers before it instead of trying one by one.
    """
    keys = list(keys)
    taken = existing.select(*keys, "name").distinct()
    first = wanted.groupBy(*keys, "name").agg(F.min("seq").alias("seq")).join(taken, [*keys, "name"], "left_anti")
    literal = first.select(*keys, "seq", "name", F.col("name").alias("unique_name"))
    rest = wanted.select(*keys, "seq", "name").join(first.select(*keys, "seq"), [*keys, "seq"], "left_anti")

    pattern = r"^(.*)" + gap + r"\(([1-9][0-9]*)\)$"
    all_taken = taken.unionByName(first.select(*keys, "name")).distinct()
    numbers = all_taken.select(
        *keys, F.regexp_extract("name", pattern, 1).alias("base"), F.regexp_extract("name", pattern, 2).try_cast("bigint").alias("n")).where("n IS NOT NULL")
    numbers = rank_in_groups(numbers, [*keys, "base"], "n", "_i").select(*keys, F.col("base").alias("name"), (F.col("n") - F.col("_i")).alias("pos"))
    ranked = rank_in_groups(rest, [*keys, "name"], "seq", "_k").withColumn("pos", F.col("_k") - 1)
    counted = count_upto(numbers, ranked, [*keys, "name"], "pos", "before")
    suffix = F.concat(F.lit(gap + "("), (F.col("_k") + F.col("before")).cast("string"), F.lit(")"))
    later = counted.select(*keys, "seq", "name", F.concat("name", suffix).alias("unique_name"))
    return literal.unionByName(later)


def unique_filenames(media: DataFrame, wanted: DataFrame) -> DataFrame:
    """File names within folder and extension; a name that already ends in ``(n)`` counts on from its base."""
    keys = ["parent_id", "extension"]
    base = F.when(F.col("name").rlike(r"\([0-9]+\)$"), F.substring_index("name", "(", 1)).otherwise(F.col("name"))
    taken = media.select(*keys, F.col("user_filename").alias("name")).distinct()
    free = wanted.join(taken, [*keys, "name"], "left_anti").groupBy(*keys, "name").agg(F.min("seq").alias("seq"))
    kept = free.select(*keys, "seq", F.col("name").alias("unique_name"))
    others = wanted.join(free.select(*keys, "seq"), [*keys, "seq"], "left_anti").withColumn("name", base)
    # the base itself is out of the question here: a request that lands on it starts at (1)
    known = taken.unionByName(free.select(*keys, "name")).unionByName(others.select(*keys, "name").distinct())
    numbered = unique_names(known, others.select(*keys, "seq", "name"), keys, "").select(*keys, "seq", "unique_name")
    return kept.unionByName(numbered)


def recent_distinct(used: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` most recently used distinct names per owner."""
    last = used.groupBy("owner_id", "name").agg(F.max("sys_id").alias("sys_id"), F.max_by("ctime", "sys_id").alias("ctime"))
    return top_in_groups(last, ["owner_id"], [F.col("sys_id").desc()], k, "place")


def revision_log(
    block: DataFrame, history: DataFrame, user_dir: DataFrame, month: int = 0, year: int = 0, order: str = "desc", page: int | None = None, rows: int = 45,
) -> DataFrame:
    """Revisions per page, language and device with author; pages are counted within that key, by date."""
    people = user_dir.select(F.col("id").alias("author_id"), "firstname", "lastname")
    heads = block.select(F.col("id").alias("master_id"), "hashtag", F.col("active").alias("active_id"))
    out = history.where(X.in_calendar("ctime", month if year else 0, year)).join(heads, "master_id").join(people, "author_id", "left").select(
        "master_id", "hashtag", "lang", "device", "author_id", "serial", "ctime", "firstname", "lastname",
        X.flag(F.col("serial") == F.col("active_id")).alias("active"), "status", "isonline")
    if page is None:
        return out
    way = [F.col(c).desc() if order.lower().startswith("d") else F.col(c).asc() for c in ("ctime", "serial")]
    return paginate(out, ["master_id", "lang", "device"], way, page, rows)


def change_history(
    history: DataFrame, media: DataFrame, user_dir: DataFrame, key: str | None = None, author: str | None = None, start: int = 0, end: int = 0,
) -> DataFrame:
    """Saved revisions (numbered within their page) and uploaded files in one list."""
    people = user_dir.select(F.col("id").alias("user_id"), "email", "firstname", "lastname")
    if not X.no_filter(key):
        people = people.where(X.starts_with("email", key))
    if not X.no_filter(author):
        people = people.where(F.col("user_id") == author)
    saved = revision_number(history).join(history.drop("master_id"), "serial").select(
        F.col("serial").alias("history_id"), F.col("master_id").alias("item_id"), "lang", "device", "status", "isonline", "ctime",
        F.lit("block").alias("type"), F.lit("saved").alias("modification"), F.col("author_id").alias("user_id"), "version")
    blank = F.lit("")
    uploaded = media.select(
        F.col("sys_id").alias("history_id"), F.col("id").alias("item_id"), blank.alias("lang"), blank.alias("device"), blank.alias("status"),
        F.lit(0).alias("isonline"), F.col("upload_time").alias("ctime"), F.col("category").alias("type"), F.lit("uploaded").alias("modification"),
        F.col("owner_id").alias("user_id"), F.lit("v1").alias("version"))
    return saved.unionByName(uploaded).where(X.in_calendar("ctime", start=start, end=end)).join(people, "user_id")


def block_get(requests: DataFrame, block: DataFrame, history: DataFrame, user_dir: DataFrame) -> DataFrame:
    """``requests(request_id, key, lang, device)`` by page id or hashtag.

    A page with a revision in that language and device comes whole, any other with its id only.
    """
    by_id = requests.join(block.withColumn("key", F.col("id")), "key")
    by_tag = requests.join(block.withColumn("key", F.col("hashtag")), "key")
    found = by_id.unionByName(by_tag).dropDuplicates(["request_id", "id"])
    have = history.select(F.col("master_id").alias("id"), "lang", "device").distinct().withColumn("ok", F.lit(True))
    people = user_dir.select(F.col("id").alias("author_id"), "firstname", "lastname")
    shown = found.join(have, ["id", "lang", "device"], "left").join(people, "author_id", "left")
    whole = {c: F.when(F.col("ok"), F.col(c)).alias(c) for c in ("active", "hashtag", "type", "firstname", "lastname", "mtime")}
    return shown.select("request_id", "id", *whole.values())


def block_list(block: DataFrame, user_dir: DataFrame, kinds: Sequence[str] = ("page", "block"), order: str = "desc", page: int = 1, rows: int = PAGE_ROWS) -> DataFrame:
    """A page of the newest (or oldest) entries of each type with author; ``place`` is the rank within the type."""
    people = user_dir.select(F.col("id").alias("author_id"), "firstname", "lastname")
    shown = block.where(F.col("type").isin(*kinds)).join(people, "author_id", "left")
    first = F.col("mtime").desc() if order.lower().startswith("d") else F.col("mtime").asc()
    page = max(int(page), 1)
    return top_in_groups(shown, ["type"], [first, F.col("id").asc()], page * rows, "place").where(F.col("place") > (page - 1) * rows)


def languages_used(history: DataFrame) -> DataFrame:
    return history.select("master_id", "lang").distinct()


def active_bases(language: DataFrame) -> DataFrame:
    """Distinct active base languages per room joined by ``:``; the number of languages bounds the list."""
    bases = language.where("state = 'active'").select("hub_id", "base").distinct()
    return bases.groupBy("hub_id").agg(F.array_join(F.array_sort(F.collect_set("base")), ":").alias("languages"))


def installed_languages(language: DataFrame, language_dir: DataFrame) -> DataFrame:
    """Active and replaced languages per room with directory names; the room's base language is its first."""
    live = language.where("state IN ('active', 'replaced')")
    base = live.groupBy("hub_id").agg(F.min("sys_id").alias("first_id"))
    return live.join(language_dir, "base").join(base, "hub_id").select(
        "hub_id", F.col("sys_id").alias("language_id"), "base", "name", "locale", "state", X.flag(F.col("sys_id") == F.col("first_id")).alias("is_base"))


def available_languages(requests: DataFrame, language: DataFrame, language_dir: DataFrame) -> DataFrame:
    """``requests(hub_id, key)``: directory languages by name prefix that the room has not installed."""
    live = language.where("state IN ('active', 'replaced')").select("hub_id", "base").distinct()
    return prefix_lookup(requests, language_dir, "name").join(live, ["hub_id", "base"], "left_anti").select("hub_id", "base", "name", "locale")


def tag_catalog(content_tag: DataFrame, block: DataFrame) -> DataFrame:
    """Online content tags per name and description with the hashtags of their pages, in bounded parts."""
    rows = content_tag.where("status = 'online'").join(block.select("id", "hashtag"), "id").select("name", F.col("description").alias("content"), "sys_id", "hashtag")
    return list_in_parts(rows, ["name", "content"], "sys_id", F.col("hashtag"), "tags").select("name", "content", "part", F.array_join("tags", " ").alias("ids"))


def tag_catalog_by_lang(content_tag: DataFrame, block: DataFrame, translate: DataFrame, lang: str) -> DataFrame:
    """The same with the name's translation and its group rank."""
    rank = content_tag.groupBy("name").agg(F.min("group_rank").alias("rank"))
    text = translate.where(F.col("lang") == lang).select(F.col("key_code").alias("name"), F.col("content").alias("translation"))
    return tag_catalog(content_tag, block).join(rank, "name").join(text, "name", "left").select("name", "ids", "part", F.col("content").alias("description"), F.col("translation").alias("content"), "rank")


def tag_assignments(requests: DataFrame, tag: DataFrame, contact: DataFrame, rooms: DataFrame) -> DataFrame:
    """``requests(request_id, owner_id, entity_id, tags JSON)`` checked: every tag must exist, and the entity must be
    a contact of the owner or a room on the owner's desk.
    """
    asked = requests.select("request_id", F.explode_outer(F.from_json("tags", "array<string>")).alias("tag_id")).where("tag_id IS NOT NULL")
    missing = asked.join(tag.select("tag_id"), "tag_id", "left_anti").select("request_id").distinct().withColumn("bad", F.lit(1))
    known = contact.select("owner_id", F.col("id").alias("entity_id")).unionByName(rooms.select("owner_id", F.col("hub_id").alias("entity_id"))).distinct().withColumn("ok", F.lit(1))
    status = F.when(F.col("bad") == 1, F.lit("TAG_NOT_FOUND")).when(F.col("ok").isNull(), F.lit("INVALID_ENTITY")).otherwise(F.lit("OK"))
    return requests.join(missing, "request_id", "left").join(known, ["owner_id", "entity_id"], "left").select("request_id", "owner_id", "entity_id", status.alias("status"))


OPERATORS = {
    "=": lambda c, v: c == v, "<>": lambda c, v: c != v, "<": lambda c, v: c < v, "<=": lambda c, v: c <= v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v,
    "like": lambda c, v: c.like(v), "in": lambda c, v: c.isin(*v), "is null": lambda c, v: c.isNull(), "is not null": lambda c, v: c.isNotNull(),
}


def table_fetch(
    table: DataFrame, columns: Sequence[str] = (), filters: Sequence[tuple[str, str, Any]] = (), order: Sequence[tuple[str, str]] = (),
    page: int | None = None, limit: int | None = None, page_length: int = 15,
) -> DataFrame:
    """Ad-hoc query over a user table.  Every name must be a column of the table; a page below 1 means the first."""
    names = [*columns, *(f[0] for f in filters), *(o[0] for o in order)]
    unknown = [n for n in names if n not in table.columns]
    if unknown:
        raise ValueError(f"unknown columns: {unknown}")
    out = table
    for name, op, value in filters:
        out = out.where(OPERATORS[op.lower()](F.col(name), value))
    keys: list[Column] = [F.col(n).desc() if way.lower() == "desc" else F.col(n).asc() for n, way in order]
    if keys:
        out = out.orderBy(*keys)
    if columns:
        out = out.select(*columns)
    if page is not None:
        return out.offset((max(page, 1) - 1) * page_length).limit(page_length)
    return out if limit is None else out.limit(limit)
