"""Tag trees: all pairs of ancestor and descendant, and what follows from them."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlor.session import cut_lineage


def tag_closure(tag: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """``(ancestor, descendant, depth)`` with every tag its own descendant at depth 0.

    One join per level; the loop ends when a level adds nothing.  ``roots(tag_id)`` restricts the ancestors.
    Each level is checkpointed, so neither the plan nor a recomputation grows with the depth.  A tag met again
    below itself (a cycle in bad data) is not followed.
    """
    edges = tag.where("parent_tag_id IS NOT NULL").select(F.col("parent_tag_id").alias("descendant"), F.col("tag_id").alias("child"))
    start = (tag if roots is None else tag.join(roots.select("tag_id").distinct(), "tag_id", "left_semi")).select("tag_id").distinct()
    level = start.select(F.col("tag_id").alias("ancestor"), F.col("tag_id").alias("descendant"), F.lit(0).alias("depth"))
    reached = level
    for depth in itertools.count(1):
        found = level.join(edges, "descendant").select("ancestor", F.col("child").alias("descendant"), F.lit(depth).alias("depth")).distinct()
        level = cut_lineage(found.join(reached, ["ancestor", "descendant"], "left_anti"))
        if level.isEmpty():
            break
        reached = reached.unionByName(level)
    return reached


def tagged_below(tag: DataFrame, map_tag: DataFrame, root: str) -> DataFrame:
    """``(owner_id, id)`` mapped to a tag or to anything below it."""
    one = tag.where(F.col("tag_id") == root)
    below = tag_closure(tag, one).select(F.col("descendant").alias("tag_id")).distinct()
    return map_tag.join(below, "tag_id", "left_semi").select("owner_id", "id").distinct()


def tag_entities(closure: DataFrame, map_tag: DataFrame) -> DataFrame:
    """Mapped entities of every tag including those of its descendants."""
    return closure.select(F.col("ancestor").alias("tag_id"), F.col("descendant").alias("leaf")).join(
        map_tag.select(F.col("tag_id").alias("leaf"), "owner_id", "id"), "leaf").select("tag_id", "owner_id", "id").distinct()


def tag_cycle_check(closure: DataFrame, proposed: DataFrame) -> DataFrame:
    """``proposed(tag_id, parent_tag_id)`` with ``is_cycle`` = the new parent lies at or below the tag."""
    below = closure.select(F.col("ancestor").alias("tag_id"), F.col("descendant").alias("parent_tag_id")).distinct().withColumn("hit", F.lit(1))
    return proposed.join(below, ["tag_id", "parent_tag_id"], "left").select("tag_id", "parent_tag_id", F.coalesce("hit", F.lit(0)).alias("is_cycle"))


def tags_below(tag: DataFrame, roots: DataFrame) -> DataFrame:
    """``(tag_id)`` of the roots and all below them. Parent pointers jump over each other until each tag has met a root or its top, so
    log2 of the number of tags bounds the rounds, cycles in bad data included."""
    wanted = roots.select("tag_id").distinct().withColumn("hit", F.lit(True))
    state = tag.groupBy("tag_id").agg(F.max("parent_tag_id").alias("up")).join(wanted, "tag_id", "left").select("tag_id", "up", F.coalesce("hit", F.lit(False)).alias("hit"))
    state = cut_lineage(state)
    for _ in range(state.count().bit_length()):
        if state.where("up IS NOT NULL AND NOT hit").isEmpty():
            break
        above = state.select(F.col("tag_id").alias("up"), F.col("up").alias("next"), F.col("hit").alias("met"))
        state = cut_lineage(state.join(above, "up", "left").select("tag_id", F.col("next").alias("up"), (F.col("hit") | F.coalesce("met", F.lit(False))).alias("hit")))
    return state.where("hit").select("tag_id")


def tag_remove(tag: DataFrame, map_tag: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tag table and mapping table without the removed tags and everything below them."""
    gone = tags_below(tag, removed)
    return tag.join(gone, "tag_id", "left_anti"), map_tag.join(gone, "tag_id", "left_anti")
