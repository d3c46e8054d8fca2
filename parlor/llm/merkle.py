"""Merkle manifest of a dataset: a root per source, one root over all, and for each row the proof that leads from its leaf to the root.

A leaf is the SHA-256 of a row's fields. Leaves of a source ascend by key; every three consecutive nodes become one until one is left; the subroots,
ordered by source, do the same. Rows are sorted by ranges, not by source, so that a source which holds a third of all rows lies in many tasks, and take
their position from the counts of earlier ranges. ``FAN ** LEVELS`` consecutive nodes are a superblock. The way up reduces superblocks to one node each and
repeats on what is left. The way down exchanges subtrees: the nodes of a superblock are cogrouped with the one row that holds the outer nodes it
needs (the other members of every run above it), and one function reduces the block, joins local and outer proof, and folds the checked leaf to the
root. No task holds more than a superblock, and rounds are the logarithm of the rows to a base of 2187.

Null key: first. Repeated rows and rows of one key: ordered by their leaf. Null fields: ``-``. Empty and very long texts: hashed like any other, one row
at a time. Empty table: no rows. Extra columns are left out, whatever their names. Null source: a source of its own, before all others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .store import is_empty, stored

FAN, LEVELS = 3, 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: What lies above a block: the runs on the way to the root, own place empty.
_OUTER = "tree long, block long, subroot string, root string, above array<array<string>>"


def leaf(fields: Sequence[Column]) -> Column:
    """Digest of the fields; a field is ``-`` if null, else its length in bytes, a colon and its value."""
    parts = []
    for c in fields:
        text = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.encode(F.concat(*parts), "UTF-8"), 256)


def _digest(parts: Sequence[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _levels(size: int) -> int:
    """Levels from a leaf to the root of a tree, at most those of a superblock."""
    n = 0
    while n < LEVELS and size > FAN**n:
        n += 1
    return n


def reduce_block(nodes: list[str], levels: int) -> list[list[str]]:
    """Nodes of each level from the leaves on."""
    rows = [nodes]
    for _ in range(levels):
        last = rows[-1]
        rows.append([_digest(last[i : i + FAN]) for i in range(0, len(last), FAN)])
    return rows


def way_up(rows: list[list[str]], place: int) -> Iterator[list[str]]:
    """The run of a leaf at each level, its own place empty."""
    for nodes in rows[:-1]:
        first = place - place % FAN
        run = nodes[first : first + FAN]
        run[place - first] = ""
        yield run
        place //= FAN


def fold(node: str, runs: Sequence[Sequence[str]]) -> str:
    for run in runs:
        node = _digest([x or node for x in run])
    return node


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` in the given order with ``part`` and ``at``: the range that holds a row and its place there. Written, so that a task that runs again changes
    nothing; the last key of the order is a row's place in its file, so that rows that are equal do not meet in one range."""
    keyed = rows.withColumn("line", F.monotonically_increasing_id())
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    sort = keyed.repartitionByRange(parts, *order, "line").sortWithinPartitions(*order, "line").drop("line")
    place = F.monotonically_increasing_id()  # the number of the task in the upper bits
    return stored(sort.withColumn("place", place).select(*rows.columns, F.shiftright("place", 33).alias("part"), F.col("place").bitwiseAND(F.lit((1 << 33) - 1)).alias("at")), "numbered")


def _positions(leaves: DataFrame) -> DataFrame:
    """Leaves with ``tree`` (rank of the source), ``position`` in it, and ``size``."""
    placed = numbered(leaves, "source", "key", "leaf")
    pieces = placed.groupBy("part", "source").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = stored(pieces.select("part", "source", "first", before.alias("before"), F.sum("n").over(Window.partitionBy("source")).alias("size")), "pieces")
    sources = numbered(pieces.select("source").distinct(), "source")
    counts = sources.groupBy("part").agg(F.count("*").alias("n"))  # one row a range
    starts = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start"))
    trees = sources.join(starts, "part").select(F.col("source").alias("of"), (F.col("start") + F.col("at")).alias("tree"))
    known = pieces.join(trees, F.col("source").eqNullSafe(F.col("of"))).select(F.col("part").alias("p"), "of", "first", "before", "size", "tree")
    joined = placed.join(known, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("of")))
    return joined.select("tree", (F.col("before") + F.col("at") - F.col("first")).alias("position"), "size", "key", F.col("leaf").alias("node"), "checked")


def _block(position: str = "position") -> Column:
    return F.floor(F.col(position) / (FAN**LEVELS)).cast("long")


def _reduced(nodes: DataFrame) -> DataFrame:
    """One node for each superblock: the nodes of the tree that is left above."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows, size = rows.sort_values("position"), int(rows["size"].iloc[0])
        top = reduce_block(rows["node"].tolist(), _levels(size))[-1][0]
        return pd.DataFrame({"tree": rows["tree"].iloc[:1], "position": rows["block"].iloc[:1], "size": -(-size // FAN**LEVELS), "node": top})

    blocks = nodes.select("tree", "position", "size", "node", _block().alias("block"))
    return stored(blocks.groupBy("tree", "block").applyInPandas(run, "tree long, position long, size long, node string"), "reduced")


def _climb(nodes: DataFrame) -> list[DataFrame]:
    """Nodes of the trees at every LEVELS-th level, the lowest first; in the last one each tree has one node."""
    levels = [nodes]
    while not is_empty(levels[-1].where("size > 1")):
        levels.append(_reduced(levels[-1]))
    return levels


def _exchange(nodes: DataFrame, outer: DataFrame, leaves: bool) -> DataFrame:
    """Superblocks meet what lies above them. For leaves the result, else what lies above each node."""
    shape = "key string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" if leaves else _OUTER

    def run(rows: pd.DataFrame, outside: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:  # an empty table has a root of trees, but no tree
            return pd.DataFrame(columns=[c.split()[0] for c in shape.split(", ")])
        rows = rows.sort_values("position")
        subroot, root, above = outside["subroot"].iloc[0], outside["root"].iloc[0], [list(x) for x in outside["above"].iloc[0]]
        local = reduce_block(rows["node"].tolist(), _levels(int(rows["size"].iloc[0])))
        ways = [[*way_up(local, i), *above] for i in range(len(rows))]
        if not leaves:
            return pd.DataFrame({"tree": rows["tree"], "block": rows["position"], "subroot": subroot or local[-1][0], "root": root or local[-1][0], "above": ways})
        proofs = [_digest([x for run in way for x in run]) for way in ways]
        folded = [fold(x, way) for x, way in zip(rows["checked"], ways)]
        return pd.DataFrame({"key": rows["key"], "leaf": rows["node"], "subroot": subroot, "root": root, "proof_sha256": proofs, "folded_root": folded, "verified": [x == root for x in folded]})

    blocks = nodes.withColumn("block", _block())
    blocks = blocks.withColumn("key", F.col("key").cast("string")) if leaves else blocks  # a null would make numbers inexact in pandas
    return blocks.groupBy("tree", "block").cogroup(outer.groupBy("tree", "block")).applyInPandas(run, shape)


def manifest(docs: DataFrame, received: Column | None = None, fields: Sequence[str] = FIELDS, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """Per row: key, leaf, subroot, root, proof_sha256 (digest of the siblings), folded_root and verified (it equals root).
    ``received``: the text as it arrived, an expression of a row's columns; its leaf is folded with the siblings of the original (default: the text)."""
    own = [F.col(c) for c in fields]
    theirs = [received if c == text and received is not None else F.col(c) for c in fields]
    leaves = stored(docs.select(F.col(key).cast("long").alias("key"), F.col(source).alias("source"), leaf(own).alias("leaf"), leaf(theirs).alias("checked")), "leaves")
    levels = _climb(stored(_positions(leaves), "positions"))
    subroots = levels[-1]  # one node a tree
    trees = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("position"), F.lit(subroots.count()).cast("long").alias("size"), "node")
    outer = docs.sparkSession.createDataFrame([(0, 0, "", "", [])], _OUTER)
    for nodes in reversed(_climb(trees)[:-1] or [trees]):
        outer = stored(_exchange(nodes, outer, leaves=False), "outer")
    tops = outer.select(F.col("block").alias("tree"), "root", "above").join(subroots.select("tree", F.col("node").alias("subroot")), "tree")
    outer = tops.select("tree", F.lit(0).cast("long").alias("block"), "subroot", "root", "above")
    for nodes in reversed(levels[1:-1]):
        outer = stored(_exchange(nodes, outer, leaves=False), "outer")
    return _exchange(levels[0], outer, leaves=True).withColumn("key", F.col("key").cast("long")).withColumnRenamed("key", key)
