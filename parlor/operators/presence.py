"""Totals over the contacts that are online."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def online_contacts(contact: DataFrame, socket: DataFrame) -> DataFrame:
    """Online contacts and their sockets per owner; sockets are counted per user before the join."""
    live = socket.where("state = 'active'").groupBy("uid").agg(F.count(F.lit(1)).alias("n"))
    return contact.join(live, "uid").groupBy("owner_id").agg(
        F.count_distinct("uid").alias("online_contacts"), F.sum("n").alias("online_sockets"))
