"""Rooms on the desks of their members, access lists and disk usage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlor.functions import expr as X
from parlor.operators.grants import GUESTS
from parlor.plans.skew import paginate


def hubs_of_user(hub_member: DataFrame, hub: DataFrame) -> DataFrame:
    """Rooms of every user outside the guest area, one row per room with the user's first privilege."""
    own = hub_member.groupBy("uid", "hub_id").agg(F.min_by("permission", "sys_id").alias("privilege"))
    rooms = hub.where("area <> 'dmz'").select(F.col("id").alias("hub_id"), "name", F.col("owner_id").alias("hub_owner_id"), "area", "serial")
    return own.join(rooms, "hub_id").select("uid", F.col("hub_id").alias("id"), "name", "hub_owner_id", "privilege", "area", "serial")


def hub_directory(nodes: DataFrame, hub: DataFrame, disk_usage: DataFrame, page: int | None = 1, rows: int = 45) -> DataFrame:
    """Desk content: ``nodes(owner_id, id, parent_id, category, user_filename, filesize, rank)``.

    A room node shows the room's own owner, name and size, a file its own; one left join instead of a
    look-up per column.  ``page`` None is all of it.
    """
    rooms = hub.select("id", F.lit("hub").alias("category"), F.col("name").alias("h_name"), F.col("area").alias("h_area")).join(
        disk_usage.select(F.col("hub_id").alias("id"), F.col("size").alias("h_size")), "id", "left")
    is_hub = F.col("category") == "hub"
    shown = nodes.join(rooms, ["id", "category"], "left").select(
        "owner_id", F.col("id").alias("nid"), F.col("parent_id").alias("pid"),
        F.when(is_hub, F.col("id")).otherwise(F.col("owner_id")).alias("hub_id"),
        F.when(is_hub, F.col("h_name")).otherwise(F.col("user_filename")).alias("filename"),
        F.when(is_hub, F.col("h_size")).otherwise(F.col("filesize")).alias("filesize"),
        F.when(is_hub, F.col("h_area")).otherwise(F.lit("personal")).alias("area"), "rank")
    return shown if page is None else paginate(shown, ["owner_id"], [F.col("rank").desc(), F.col("filename").desc(), F.col("nid").asc()], page, rows)


def privilege(requests: DataFrame, hub_member: DataFrame, hub: DataFrame) -> DataFrame:
    """``requests(hub_id, uid)``: the member's privilege; 1 in public rooms, else -1 for a guest id and 0 for a user."""
    member = hub_member.groupBy("hub_id", "uid").agg(F.min_by("permission", "sys_id").alias("permission"))
    area = hub.select(F.col("id").alias("hub_id"), "area")
    rest = F.when(F.col("area") == "public", F.lit(1)).when(F.col("uid").isin(*GUESTS, ""), F.lit(-1)).otherwise(F.lit(0))
    return (
        requests.select("hub_id", "uid").distinct().join(area, "hub_id").join(member, ["hub_id", "uid"], "left")
        .select("hub_id", "uid", F.coalesce("permission", rest).alias("privilege"))
    )


def hub_access(hub_member: DataFrame, user_dir: DataFrame, key: str | None = None, without: str | None = None) -> DataFrame:
    """Members of every room with name, e-mail and privilege; by name prefix, minus one id."""
    rows = hub_member if without is None else hub_member.where(F.col("uid") != without)
    people = user_dir.select(F.col("id").alias("uid"), "firstname", "lastname", "email").where(X.any_starts_with(["firstname", "lastname", "email"], key))
    return rows.join(people, "uid").select(
        "hub_id", "uid", "firstname", "lastname", "email", F.col("permission").alias("privilege"),
        X.flag(X.has_bit("permission", X.ADMIN_BIT)).alias("is_admin"), X.flag(F.col("permission") == X.OWNER_MASK).alias("is_owner"))


def data_usage(media: DataFrame, hub: DataFrame, disk_usage: DataFrame) -> DataFrame:
    """Bytes in the user's own files and in the rooms the user owns; sums stay whole numbers."""
    personal = media.groupBy("owner_id").agg(F.sum("filesize").alias("personal"))
    owned = hub.select("owner_id", F.col("id").alias("hub_id")).join(disk_usage, "hub_id").groupBy("owner_id").agg(F.sum("size").alias("hub"))
    return personal.join(owned, "owner_id", "full").select(
        "owner_id", F.coalesce("personal", F.lit(0)).alias("personal"), F.coalesce("hub", F.lit(0)).alias("hub"))


def disk_adjust(disk_usage: DataFrame, removed: DataFrame) -> DataFrame:
    """Usage after the files ``removed(hub_id, filesize)`` are gone."""
    freed = removed.groupBy("hub_id").agg(F.sum("filesize").alias("freed"))
    return disk_usage.join(freed, "hub_id", "left").select("hub_id", (F.col("size") - F.coalesce("freed", F.lit(0))).alias("size"))
