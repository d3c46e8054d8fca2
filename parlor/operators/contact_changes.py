"""Invitations, directory sync and edits of contact lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlor.functions import expr as X
from parlor.plans.skew import rank_in_groups

STATES = ("none", "memory", "sent", "received", "invitation", "informed", "active")
EVENTS = ("invite", "accept", "acknowledge", "refuse", "delete")
CHUNK = 4096


def step(event: str, mine: str, his: str) -> tuple[str, str]:
    """States of the acting side's row and of the other side's row after one event."""
    if event == "invite":
        if his in ("none", "received"):
            return "sent", "received"
        if his in ("memory", "invitation"):
            return "sent", "invitation"
        if his in ("sent", "informed"):
            return "active", "informed"
        return "informed", "active"
    if event == "accept" and mine in ("received", "invitation"):
        return "active", "informed" if his != "none" else "none"
    if event == "acknowledge" and mine == "informed":
        return "active", his
    if event == "refuse":
        return {"received": "none", "invitation": "memory"}.get(mine, mine), his
    if event == "delete" and mine != "none":
        return "none", "none" if his in ("none", "received") else "memory"
    return mine, his


def _table() -> list[list[int]]:
    """``[kind][state]``: kind = 2 * event + (0 when the smaller id acts), state = 7 * smaller side + larger side."""
    n, kinds = len(STATES), []
    for event in EVENTS:
        for larger_acts in (False, True):
            row = []
            for low in STATES:
                for high in STATES:
                    if larger_acts:
                        h, l = step(event, high, low)
                    else:
                        l, h = step(event, low, high)
                    row.append(STATES.index(l) * n + STATES.index(h))
            kinds.append(row)
    return kinds


TABLE = _table()
ALL = len(STATES) ** 2


def _literal(rows: list[list[int]]) -> Column:
    return F.array(*[F.array(*[F.lit(x) for x in row]) for row in rows])


def pair_events(events: DataFrame) -> DataFrame:
    """``events(seq, actor, target, event)`` keyed by the unordered pair, with their kind."""
    kind = F.lit(None)
    for i, name in enumerate(EVENTS):
        kind = F.when(F.col("event") == name, F.lit(2 * i)).otherwise(kind)
    known = events.where(F.col("event").isin(*EVENTS)).where("actor <> target")
    return known.select("seq", F.least("actor", "target").alias("low"), F.greatest("actor", "target").alias("high"),
                        (kind + F.when(F.col("actor") > F.col("target"), F.lit(1)).otherwise(F.lit(0))).alias("kind"))


def pair_functions(events: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``(low, high, fn)``: the state a pair ends in, for each state it may start in.

    Composition of state changes is associative, so a pair's events are folded chunk by chunk, then chunks of
    chunks: no task collects more than ``chunk`` entries of a pair at the first two levels.
    """
    pair = ["low", "high"]
    ranked = rank_in_groups(pair_events(events), pair, "seq", "_r").withColumn("c1", F.expr(f"CAST((_r - 1) DIV {chunk} AS BIGINT)"))
    identity = F.array(*[F.lit(i) for i in range(ALL)])
    table = _literal(TABLE)

    # the transition rows ride on the group row, so that the lambda reads them as a plain column
    level = ranked.groupBy(*pair, "c1").agg(F.array_sort(F.collect_list(F.struct("seq", "kind"))).alias("es")).withColumn("t", table).select(
        *pair, "c1", F.aggregate("es", identity, lambda acc, e: F.transform(acc, lambda s: F.get(F.get(F.col("t"), e["kind"]), s))).alias("fn"))

    def compose(rows: DataFrame, by: list[str], order: str) -> DataFrame:
        return rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(order, "fn"))).alias("fs")).select(
            *by, F.aggregate("fs", identity, lambda acc, e: F.transform(acc, lambda s: F.get(e["fn"], s))).alias("fn"))

    level = compose(level.withColumn("c2", F.expr(f"CAST(c1 DIV {chunk} AS BIGINT)")), [*pair, "c2"], "c1")
    return compose(level, pair, "c2")


def state_rows(pairs: DataFrame, state: str = "state") -> DataFrame:
    """Both sides' rows of a pair state; ``none`` is no row."""
    names = F.array(*[F.lit(s) for s in STATES])
    low, high = F.expr(f"CAST({state} DIV {len(STATES)} AS INT)"), F.expr(f"CAST({state} % {len(STATES)} AS INT)")
    sides = F.array(
        F.struct(F.col("low").alias("owner_id"), F.col("high").alias("entity"), F.get(names, low).alias("status")),
        F.struct(F.col("high").alias("owner_id"), F.col("low").alias("entity"), F.get(names, high).alias("status")))
    uid = F.when(F.col("status").isin("informed", "active"), F.col("entity"))
    return pairs.select(F.explode(sides).alias("s")).select("s.*").where("status <> 'none'").withColumn("uid", uid)


def invitation_fold(events: DataFrame, chunk: int = CHUNK, user_dir: DataFrame | None = None) -> DataFrame:
    """Relation of every (owner, counterpart) after all events, from nothing: ``(owner_id, entity, status, uid)``.

    With ``user_dir`` only its users keep a row: whoever invites a stranger has ``sent``, the stranger nothing.
    """
    rows = state_rows(pair_functions(events, chunk).select("low", "high", F.get("fn", F.lit(0)).alias("state")))
    return rows if user_dir is None else rows.join(user_dir.select(F.col("id").alias("owner_id")), "owner_id", "left_semi")


def email_invites(token: DataFrame, user_dir: DataFrame, contact: DataFrame) -> dict[str, DataFrame]:
    """Invitations sent to an e-mail that now belongs to a user.

    ``received``: one new contact per inviter the user does not know yet.  ``contact``: the inviters' entries carry
    the user's id instead of the e-mail.  ``token``: used tokens are passive.
    """
    people = user_dir.select("email", F.col("id").alias("user_id"))
    live = token.where("status = 'active' AND inviter_id IS NOT NULL").join(people, "email").where("user_id <> inviter_id")
    pairs = live.select(F.col("user_id").alias("owner_id"), F.col("inviter_id").alias("entity")).distinct()
    names = user_dir.select(F.col("id").alias("entity"), "firstname", "lastname")
    received = pairs.join(contact.select("owner_id", "entity").distinct(), ["owner_id", "entity"], "left_anti").join(names, "entity").select(
        "owner_id", "entity", "firstname", "lastname", F.lit("received").alias("status"), X.short_id("owner_id", "entity").alias("id"))
    by_mail = live.select(F.col("inviter_id").alias("owner_id"), F.col("email").alias("entity"), "user_id").distinct()
    rewritten = contact.join(by_mail, ["owner_id", "entity"], "left").withColumn("entity", F.coalesce("user_id", "entity")).drop("user_id").select(*contact.columns)
    used = live.select("email").distinct().withColumn("used", F.lit(1))
    tokens = token.join(used, "email", "left").withColumn("status", F.when((F.col("used") == 1) & F.col("inviter_id").isNotNull(), F.lit("passive")).otherwise(F.col("status"))).drop("used")
    return {"received": received, "contact": rewritten, "token": tokens.select(*token.columns)}


def contact_sync(sync: DataFrame, user_dir: DataFrame, contact: DataFrame, contact_email: DataFrame, contact_phone: DataFrame, contact_address: DataFrame) -> dict[str, DataFrame]:
    """Directory changes pushed into the contact lists that asked for them; the pairs end ``ok`` or, deleted, go.

    A synced contact has the user's id as its own.  Names, e-mail, phone and address come from the directory.
    """
    due = sync.where("status <> 'ok'").select("owner_id", "uid", "status").distinct()
    keys = due.select("owner_id", F.col("uid").alias("entity"))
    children = due.select("owner_id", F.col("uid").alias("contact_id"))
    source = user_dir.select(F.col("id").alias("uid"), "email", "firstname", "lastname", "profile")
    put = due.where("status <> 'delete'").join(source, "uid")
    own = contact.select("owner_id", "id", "entity", "uid", "firstname", "lastname", "status")
    gone = due.where("status = 'delete'").select("owner_id", F.col("uid").alias("id"))
    kept = own.join(keys, ["owner_id", "entity"], "left_anti").join(gone, ["owner_id", "id"], "left_anti")
    new = put.select("owner_id", F.col("uid").alias("id"), F.col("uid").alias("entity"), "uid", "firstname", "lastname", F.lit("active").alias("status"))
    kept = kept.join(new.select("owner_id", "id"), ["owner_id", "id"], "left_anti")

    def child(table: DataFrame, rows: DataFrame) -> DataFrame:
        cols = rows.columns
        return table.select(*cols).join(children, ["owner_id", "contact_id"], "left_anti").unionByName(rows)

    mail = put.select("owner_id", F.col("uid").alias("contact_id"), "email", F.lit("prof").alias("category"), F.lit(1).alias("is_default"))
    phone = put.select("owner_id", F.col("uid").alias("contact_id"), F.get_json_object("profile", "$.areacode").alias("areacode"),
                       F.get_json_object("profile", "$.mobile").alias("phone"), F.lit("prof").alias("category"))
    place = put.select("owner_id", F.col("uid").alias("contact_id"), F.get_json_object("profile", "$.address").alias("address"), F.lit("prof").alias("category"))
    return {
        "contact": kept.unionByName(new), "email": child(contact_email, mail), "phone": child(contact_phone, phone), "address": child(contact_address, place),
        "sync": sync.where("status <> 'delete'").withColumn("status", F.lit("ok")),
    }


def children_from_json(requests: DataFrame) -> dict[str, DataFrame]:
    """``requests(owner_id, contact_id, emails, phones, addresses)`` (JSON arrays) as child rows with repeatable ids.

    The stored address keeps only the parts that are given.
    """
    key = ["owner_id", "contact_id"]

    def rows(column: str, schema: str) -> DataFrame:
        return requests.select(*key, F.posexplode(F.from_json(column, f"array<struct<{schema}>>")).alias("pos", "x")).select(
            *key, X.short_id("owner_id", "contact_id", F.lit(column), F.col("pos").cast("string")).alias("id"), "x.*")

    places = rows("addresses", "street:string,city:string,country:string,category:string")
    return {
        "email": rows("emails", "email:string,category:string,is_default:int"), "phone": rows("phones", "areacode:string,phone:string,category:string"),
        "address": places.select(*key, "id", F.to_json(F.struct("street", "city", "country")).alias("address"), "category"),
    }


def replace_children(table: DataFrame, rows: DataFrame, replaced: DataFrame) -> DataFrame:
    """Children after dropping all of the ``replaced(owner_id, contact_id)`` contacts' rows and adding ``rows``."""
    key = ["owner_id", "contact_id"]
    cols = rows.columns
    return table.select(*cols).join(replaced.select(*key).distinct(), key, "left_anti").unionByName(rows)


def delete_contacts(gone: DataFrame, contact: DataFrame, children: dict[str, DataFrame], map_tag: DataFrame, contact_block: DataFrame) -> dict[str, DataFrame]:
    """Contacts ``gone(owner_id, id)`` with their children, tags and blocks."""
    key = gone.select("owner_id", "id").distinct()
    by_contact = key.withColumnRenamed("id", "contact_id")
    out = {"contact": contact.join(key, ["owner_id", "id"], "left_anti"), "map_tag": map_tag.join(key, ["owner_id", "id"], "left_anti"),
           "contact_block": contact_block.join(by_contact, ["owner_id", "contact_id"], "left_anti")}
    for name, table in children.items():
        out[name] = table.join(by_contact, ["owner_id", "contact_id"], "left_anti")
    return out


def contact_edit(edits: DataFrame, contact: DataFrame) -> DataFrame:
    """Contacts after ``edits(owner_id, id, surname, firstname, lastname, message, entity, seq)``, the last per contact.

    Empty strings become NULL.  A new entity on a contact that was not yet accepted resets it to ``memory`` and takes
    back the invitation that waits, ``received``, in the old entity's list.
    """
    fields = ("surname", "firstname", "lastname", "message", "entity")
    last = edits.groupBy("owner_id", "id").agg(F.max_by(F.struct(*[F.nullif(c, F.lit("")).alias(f"n_{c}") for c in fields]), "seq").alias("e")).select("owner_id", "id", "e.*", F.lit(True).alias("edited"))
    both = contact.join(last, ["owner_id", "id"], "left")
    moved = F.col("edited") & ~F.col("status").isin("informed", "received", "active") & (F.col("n_entity") != F.col("entity"))
    withdrawn = both.where(moved).select(F.col("entity").alias("owner_id"), F.col("owner_id").alias("entity"), F.lit("received").alias("status")).distinct()
    new = {c: F.when(F.col("edited"), F.col(f"n_{c}")).otherwise(F.col(c)) for c in fields}
    status = F.when(moved, F.lit("memory")).otherwise(F.col("status"))
    changed = both.join(withdrawn.withColumn("back", F.lit(1)), ["owner_id", "entity", "status"], "left").where("back IS NULL")
    return changed.withColumns({"_status": status, **{f"_{c}": v for c, v in new.items()}}).select(
        "owner_id", "id", *[F.col(f"_{c}").alias(c) for c in fields], F.col("_status").alias("status"), "uid")
