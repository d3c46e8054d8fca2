"""Declared schemas of the data model, loading with value checks, and clustered writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Column names and types of the stored tables, with the tenant column first.
SCHEMAS: dict[str, str] = {
    "channel": "owner_id string, sys_id bigint, author_id string, entity_id string, message string, message_id string, thread_id string, attachment string, ctime bigint, metadata string",
    "read_channel": "owner_id string, entity_id string, uid string, ref_sys_id bigint",
    "team_channel": "hub_id string, sys_id bigint, author_id string, message_id string, message string, thread_id string, attachment string, ctime bigint, metadata string",
    "team_read": "hub_id string, uid string, ref_sys_id bigint, ctime bigint",
    "team_delete": "hub_id string, uid string, ref_sys_id bigint",
    "contact": "owner_id string, sys_id bigint, id string, surname string, firstname string, lastname string, entity string, uid string, status string, source string, metadata string, message string, ctime bigint, mtime bigint",
    "contact_email": "owner_id string, sys_id bigint, id string, email string, category string, is_default int, contact_id string",
    "contact_phone": "owner_id string, sys_id bigint, id string, areacode string, phone string, category string, contact_id string",
    "contact_address": "owner_id string, sys_id bigint, id string, address string, category string, contact_id string",
    "contact_block": "owner_id string, sys_id bigint, contact_id string, entity string, uid string",
    "archive_entity": "owner_id string, entity_id string",
    "tag": "tag_id string, parent_tag_id string, name string, position int",
    "map_tag": "owner_id string, tag_id string, id string",
    "hub_media": "hub_id string, sys_id bigint, id string, owner_id string, file_path string, user_filename string, extension string, mimetype string, category string, filesize bigint, upload_time bigint, metadata string",
    "permission": "resource_id string, entity_id string, permission int, expiry_time bigint",
    "block_history": "serial bigint, author_id string, master_id string, lang string, device string, status string, isonline int, ctime bigint",
    "action_log": "sys_id bigint, uid string, action string, category string, notify_to string, entity_id string, log string, ctime bigint",
    "login_log": "owner_id string, sys_id bigint, cookie_id string, metadata string, intime bigint, outtime bigint",
    "language": "hub_id string, sys_id bigint, base string, state string",
}

# The value sets of the enum columns.
ENUMS: dict[str, dict[str, tuple[str, ...]]] = {
    "contact": {"status": ("memory", "sent", "received", "invitation", "informed", "accept", "active")},
    "contact_email": {"category": ("prof", "priv")},
    "contact_phone": {"category": ("prof", "priv")},
    "contact_address": {"category": ("prof", "priv")},
    "block_history": {"device": ("desktop", "tablet", "mobile"), "status": ("draft", "history")},
    "action_log": {
        "action": ("added", "deleted", "changed", "left", "removed", "backup", "connection"),
        "category": ("media", "permission", "member", "admin", "title"),
        "notify_to": ("all", "member", "admin"),
    },
    "language": {"state": ("deleted", "active", "frozen", "replaced")},
}

JSON_COLUMNS: dict[str, tuple[str, ...]] = {
    "channel": ("attachment", "metadata"), "team_channel": ("attachment", "metadata"), "contact": ("metadata",), "contact_address": ("address",),
    "hub_media": ("metadata",), "login_log": ("metadata",),
}

TENANT = {"tag": "tag_id", "permission": "resource_id", "block_history": "master_id", "action_log": "sys_id"}


def names(schema: str) -> list[str]:
    return [c.strip().split(" ")[0] for c in schema.split(",")]


def checks(table: str) -> tuple[Column, Column]:
    """Whether a row breaks an enum, and whether it breaks a JSON column."""
    bad_enum, bad_json = F.lit(False), F.lit(False)
    for column, values in ENUMS.get(table, {}).items():
        bad_enum = bad_enum | (F.col(column).isNotNull() & ~F.col(column).isin(*values))
    for column in JSON_COLUMNS.get(table, ()):
        bad_json = bad_json | (F.col(column).isNotNull() & F.try_parse_json(column).isNull())
    return bad_enum, bad_json


def conform(df: DataFrame, table: str) -> DataFrame:
    """Declared columns and types, plus ``bad_enum`` and ``bad_json``."""
    typed = [F.col(c.strip().split(" ")[0]).cast(c.strip().split(" ")[1]) for c in SCHEMAS[table].split(",")]
    bad_enum, bad_json = checks(table)
    return df.select(*typed).withColumns({"bad_enum": bad_enum, "bad_json": bad_json})


def load(spark: SparkSession, folder: str, *tables: str) -> dict[str, DataFrame]:
    """Stored tables of all tenants, read with their declared schema (no inference, columns pruned by the plan)."""
    return {t: conform(spark.read.schema(SCHEMAS[t]).parquet(f"{folder}/{t}"), t) for t in (tables or tuple(SCHEMAS))}


def save(df: DataFrame, folder: str, table: str, partitions: int | None = None, then: str | None = None) -> None:
    """Write clustered by tenant, so that a filter on one tenant skips files and row groups.

    Range partitions on tenant and a second column split a tenant that is larger than a partition.
    """
    tenant = TENANT.get(table, names(SCHEMAS[table])[0])
    order = [tenant, *([then] if then else [c for c in ("sys_id", "ref_sys_id", "serial") if c in df.columns and c != tenant][:1])]
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    ranged.sortWithinPartitions(*order).select(*names(SCHEMAS[table])).write.mode("overwrite").parquet(f"{folder}/{table}")


def table_report(frames: dict[str, DataFrame]) -> DataFrame:
    """Rows and rule-breaking rows per table."""
    out = None
    for table, df in frames.items():
        row = df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("bad_enum").alias("n_bad_enum"), F.count_if("bad_json").alias("n_bad_json")).select(
            F.lit(table).alias("table_name"), "*")
        out = row if out is None else out.unionByName(row)
    return out
