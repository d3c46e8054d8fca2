"""Change sets applied to tables: a table and its changes in, the new table out.

Every job is idempotent: applied twice, the second run changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(table: DataFrame, changes: DataFrame, keys: Sequence[str], seq: str = "seq") -> DataFrame:
    """Apply ``changes(table columns, op, seq)`` by key.

    ``upsert`` and ``delete`` settle a key, the last one wins; ``insert`` only fills a key that is then empty,
    and of several the first wins.  One aggregation of the changes and anti joins on the key.
    """
    keys, columns = list(keys), table.columns
    row = F.struct(*columns)
    settled = changes.where(F.col("op").isin("upsert", "delete")).groupBy(*keys).agg(
        F.max_by(F.struct("op", row.alias("r")), seq).alias("d"), F.max(seq).alias("d_seq"))
    put = settled.where("d.op = 'upsert'").select("d.r.*").select(*columns)
    base = table.join(settled.select(*keys), keys, "left_anti").unionByName(put)
    inserts = changes.where("op = 'insert'")
    late = inserts.join(settled.select(*keys, "d_seq"), keys, "left").where(F.col("d_seq").isNull() | (F.col(seq) > F.col("d_seq")))
    filled = late.groupBy(*keys).agg(F.min_by(row, seq).alias("r")).select("r.*").select(*columns)
    return base.unionByName(filled.join(base.select(*keys), keys, "left_anti"))


def delete_keys(table: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return table.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def positions_from_list(orders: DataFrame, table: DataFrame, key: str, tenant: Sequence[str] = ("owner_id",)) -> DataFrame:
    """New positions from the order of a JSON list: ``orders(tenant, ids)``; ids not listed keep theirs."""
    listed = orders.select(*tenant, F.posexplode(F.from_json("ids", "array<string>")).alias("new_position", key))
    listed = listed.groupBy(*tenant, key).agg(F.min("new_position").alias("new_position"))
    return table.join(listed, [*tenant, key], "left").withColumn("position", F.coalesce("new_position", "position")).drop("new_position").select(*table.columns)


def block_edit(contact_block: DataFrame, contact: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """Blocks after adding ``added(owner_id, contact_id)`` and dropping ``removed(owner_id, contact_id)``.

    The blocked uid and entity are copied from the contact, also for blocks that are already there.
    """
    keys = ["owner_id", "contact_id"]
    wanted = contact_block.select(*keys).unionByName(added.select(*keys)).distinct().join(removed.select(*keys).distinct(), keys, "left_anti")
    now = contact.select("owner_id", F.col("id").alias("contact_id"), F.col("entity").alias("c_entity"), F.col("uid").alias("c_uid"), F.lit(1).alias("known"))
    old = contact_block.select(*keys, "entity", "uid")
    known = F.col("known") == 1
    return (
        wanted.join(now, keys, "left").join(old, keys, "left").where(known | F.col("entity").isNotNull() | F.col("uid").isNotNull())
        .select(*keys, F.when(known, F.col("c_entity")).otherwise(F.col("entity")).alias("entity"), F.when(known, F.col("c_uid")).otherwise(F.col("uid")).alias("uid"))
    )
