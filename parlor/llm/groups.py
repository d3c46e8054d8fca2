"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .store import is_empty, stored


def components(edges: DataFrame) -> DataFrame:
    """(id, label) of all nodes of the edges (a, b); nodes of a component share a label. Each round joins every node to its neighbour of least random
    rank and contracts; the rank changes each round, so a constant share of the nodes goes and the rounds are logarithmic, whatever the shape."""
    edges = stored(edges.select("a", "b"), "edges")
    labels = stored(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("label", F.col("id")), "labels")
    turn = 0
    while not is_empty(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("h"), F.col(c).alias("id"))  # noqa: E731,B023
        nearest = both.groupBy("a").agg(F.min(rank("b")).alias("x")).select(F.col("a").alias("node"), F.least(rank("a"), F.col("x"))["id"].alias("to"))
        step = stored(nearest, "step")
        labels = stored(labels.join(step, labels["label"] == step["node"], "left").select("id", F.coalesce("to", "label").alias("label")), "labels")
        ends = edges.join(step.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(step.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        edges = stored(ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        turn += 1
    return labels
