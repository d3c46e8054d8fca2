"""Plan shapes that stay bounded when one group holds a large share of all rows.

A window over a hot group runs in one task.  The helpers below cut a group into blocks of a
whole-number sequence (``sys_id``, epoch, position), work inside the blocks, and carry a small
per-block summary across.  As the sequence is unique in its group, a block never holds more than
``BLOCK`` rows.  Salts and blocks are functions of the row, so a retried task repeats them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 20
SALTS = 32
PART = 10_000
PAGE_ROWS = 45


def _block(pos: str, width: int) -> Column:
    return F.expr(f"CAST({pos} AS BIGINT) DIV {width}")


def rank_in_groups(
    df: DataFrame, keys: Sequence[str], seq: str, name: str = "rank", desc: bool = False, width: int = BLOCK
) -> DataFrame:
    """1-based position of each row in its group, by a sequence that is unique in the group.

    Only block sizes cross the group; rows are sorted block by block.  Keys must not be NULL.
    """
    keys = list(keys)
    rows = df.withColumn("_block", _block(seq, width))
    direction = (lambda c: F.col(c).desc()) if desc else (lambda c: F.col(c).asc())
    across = Window.partitionBy(*keys).orderBy(direction("_block")).rowsBetween(Window.unboundedPreceding, -1)
    sizes = (
        rows.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(across), F.lit(0))).drop("_n")
    )
    inside = Window.partitionBy(*keys, "_block").orderBy(direction(seq))
    return (
        rows.withColumn("_pos", F.row_number().over(inside))
        .join(sizes, [*keys, "_block"])
        .withColumn(name, F.col("_before") + F.col("_pos"))
        .drop("_before", "_pos", "_block")
    )


def top_in_groups(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "rank", salts: int = SALTS
) -> DataFrame:
    """First ``k`` rows of each group under a total order, with their 1-based rank.

    Each salt keeps its own first ``k``; the group's first ``k`` are among them, so the result is exact
    and the last window sees at most ``salts * k`` rows of any group.
    """
    keys = list(keys)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
    first = Window.partitionBy(*keys, "_salt").orderBy(*order)
    last = Window.partitionBy(*keys).orderBy(*order)
    return (
        salted.withColumn("_cut", F.row_number().over(first)).where(F.col("_cut") <= k)
        .drop("_salt", "_cut")
        .withColumn(name, F.row_number().over(last)).where(F.col(name) <= k)
    )


def paginate(df: DataFrame, keys: Sequence[str], order: Sequence[Column], page: int = 1, rows: int = PAGE_ROWS) -> DataFrame:
    """One page of every tenant; a page below 1 means the first."""
    page = max(int(page), 1)
    return top_in_groups(df, keys, order, page * rows, "_rank").where(F.col("_rank") > (page - 1) * rows).drop("_rank")


def _large_groups(width: int, keys: Sequence[str], *tables: DataFrame) -> DataFrame:
    """Groups with more than ``width`` rows in one of the tables.  Of N rows at most N / ``width`` groups are, so the list is small however
    large the tables are; the hint keeps the tables from being shuffled to learn that."""
    found = None
    for rows in tables:
        over = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > width).select(*keys)
        found = over if found is None else found.unionByName(over)
    return F.broadcast(found.distinct())


def count_in_blocks(
    events: DataFrame, probes: DataFrame, keys: Sequence[str], pos: str, name: str = "n_upto", width: int = BLOCK
) -> DataFrame:
    """``count_upto`` for groups of any size, and for probes that mostly share their positions.  Equal positions are added up before the shuffle and equal probes are asked once, so a
    block holds at most ``2 * width`` rows; the probes are shuffled again to meet their answers."""
    at = events.groupBy(*keys, pos).agg(F.count(F.lit(1)).alias("_n")).withColumn("_probe", F.lit(0))
    asked = probes.select(*keys, pos).distinct().withColumn("_n", F.lit(0).cast("bigint")).withColumn("_probe", F.lit(1))
    both = at.unionByName(asked).withColumn("_block", _block(pos, width))
    across = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (
        both.groupBy(*keys, "_block").agg(F.sum("_n").alias("_s"))
        .withColumn("_before", F.coalesce(F.sum("_s").over(across), F.lit(0))).drop("_s")
    )
    inside = (
        Window.partitionBy(*keys, "_block").orderBy(pos, "_probe")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    answers = (
        both.withColumn("_run", F.sum("_n").over(inside)).where("_probe = 1")
        .join(sizes, [*keys, "_block"])
        .select(*keys, pos, (F.col("_before") + F.col("_run")).alias(name))
    )
    return probes.join(answers, [*keys, pos])


def count_upto(
    events: DataFrame, probes: DataFrame, keys: Sequence[str], pos: str, name: str = "n_upto", width: int = BLOCK,
    total: str | None = None, newest: str | None = None, own: tuple[str, str] | None = None,
) -> DataFrame:
    """For each probe ``(keys, pos, …)``: how many events of its group lie at or before ``pos``.

    Replaces the theta join ``event.pos <= probe.pos``.  Events and probes of a group meet in one shuffle that the probes pass with
    all their columns; groups with more than ``width`` events or probes are counted in blocks.  Probes with a NULL key or position
    have no answer.  From the same shuffle come, where asked for: ``total``, a column with the number of all events of the group;
    ``newest``, a column of the events, with its value at the last position (NULL without events); and ``own`` = (member, column), where
    ``member`` is a column of both tables: the number of the member's own events beyond ``pos``.
    """
    keys = list(keys)
    probes = probes.dropna(subset=[*keys, pos])
    large = _large_groups(width, keys, events, probes)
    extra = [c for c in (total, newest, own and own[1]) if c]
    # groups of usual size: one pass
    here = [*keys, pos, *([own[0]] if own else [])]
    at = events.join(large, keys, "left_anti").groupBy(*here).agg(F.count(F.lit(1)).alias("_n"), *([F.max(newest).alias(newest)] if newest else []))
    rows = at.withColumn("_probe", F.lit(0)).unionByName(
        probes.join(large, keys, "left_anti").withColumns({"_n": F.lit(0).cast("bigint"), "_probe": F.lit(1)}), allowMissingColumns=True)
    group = Window.partitionBy(*keys)
    upto = lambda *by: Window.partitionBy(*by).orderBy(pos, "_probe").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    usual = rows.withColumn(name, F.sum("_n").over(upto(*keys)))
    if total:
        usual = usual.withColumn(total, F.sum("_n").over(group))
    if newest:
        usual = usual.withColumn(newest, F.max_by(newest, F.when(F.col("_probe") == 0, F.col(pos))).over(group))
    if own:
        mine = [*keys, own[0]]
        beyond = F.sum("_n").over(Window.partitionBy(*mine)) - F.sum("_n").over(upto(*mine))
        usual = usual.withColumn(own[1], F.when(F.col(own[0]).isNull(), F.lit(0)).otherwise(beyond))
    usual = usual.where("_probe = 1").select(*probes.columns, name, *extra)
    # large ones: in blocks
    events, probes = events.join(large, keys, "left_semi"), probes.join(large, keys, "left_semi")
    blocks = count_in_blocks(events, probes, keys, pos, name, width)
    if total or newest:
        about = events.groupBy(*keys).agg(F.count(F.lit(1)).alias(total or "_n"), *([F.max_by(newest, pos).alias(newest)] if newest else []))
        blocks = blocks.join(about, keys, "left")
    if total:
        blocks = blocks.withColumn(total, F.coalesce(total, F.lit(0)))
    if own:
        mine = [*keys, own[0]]
        asked, his = probes.select(*mine, pos).distinct().withColumnRenamed(pos, "_pos"), events.select(*mine, pos)
        beyond = his.join(asked, mine).where(F.col(pos) > F.col("_pos")).groupBy(*mine, F.col("_pos").alias(pos)).agg(F.count(F.lit(1)).alias(own[1]))
        blocks = blocks.join(beyond, [*mine, pos], "left").withColumn(own[1], F.coalesce(own[1], F.lit(0)))
    return usual.unionByName(blocks.select(*usual.columns))


def first_not_excluded(
    items: DataFrame, members: DataFrame, exclusions: DataFrame, keys: Sequence[str], member: str, seq: str,
    width: int = BLOCK, hidden_count: str | None = None,
) -> DataFrame:
    """Newest item of the group per member, leaving out the items excluded for that member.

    ``items(keys, seq, …)``, ``members(keys, member, …)``, ``exclusions(keys, member, seq)``.
    Items are ranked newest first.  A member's excluded ranks, in order, read 1, 2, 3, … up to the first
    gap, and the gap is the answer: linear in items + exclusions, never items x members.  The gap is looked for
    in blocks of ranks; only blocks without a gap, which are rare, lead on to the next.
    ``hidden_count`` names an optional column with the number of excluded items.
    """
    keys = list(keys)
    whom = [*keys, member]
    ranked = rank_in_groups(items, keys, seq, "_item", desc=True, width=width)
    hidden = (
        exclusions.select(*whom, seq).distinct()
        .join(ranked.select(*keys, seq, (F.col("_item") - 1).alias("_at")), [*keys, seq])
        .withColumn("_block", _block("_at", width))
        .withColumn("_nth", F.row_number().over(Window.partitionBy(*whom, "_block").orderBy("_at")) - 1)
    )
    start = F.col("_block") * width
    blocks = hidden.groupBy(*whom, "_block").agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.when(F.col("_at") - start > F.col("_nth"), start + F.col("_nth"))).alias("_hole")
    ).withColumn("_hole", F.coalesce("_hole", start + F.col("_n")))
    first = F.col("_block") == 0
    per = blocks.groupBy(*whom).agg(
        F.sum("_n").alias("_hidden"), F.max(F.when(first, F.col("_n"))).alias("_n0"), F.max(F.when(first, F.col("_hole"))).alias("_hole0"))
    # members whose first block has no gap: the first block that is not full holds it
    full = blocks.where(F.col("_n") == width).withColumn("_k", F.row_number().over(Window.partitionBy(*whom).orderBy("_block")) - 1)
    stop = full.groupBy(*whom).agg(F.coalesce(F.min(F.when(F.col("_block") > F.col("_k"), F.col("_k"))), F.count(F.lit(1))).cast("bigint").alias("_block"))
    later = stop.join(blocks.where(F.col("_n") < width).select(*whom, "_block", "_hole"), [*whom, "_block"], "left").select(
        *whom, F.coalesce("_hole", F.col("_block") * width).alias("_later"))
    gap = F.when(F.col("_n0").isNull(), F.lit(0)).when(F.col("_n0") < width, F.col("_hole0")).otherwise(F.col("_later"))
    wanted = members.join(per, whom, "left").join(later, whom, "left").withColumn("_item", gap + 1)
    if hidden_count:
        wanted = wanted.withColumn(hidden_count, F.coalesce("_hidden", F.lit(0)))
    wanted = wanted.drop("_hidden", "_n0", "_hole0", "_later")
    return wanted.join(ranked, [*keys, "_item"], "left").drop("_item")


def list_in_parts(
    df: DataFrame, keys: Sequence[str], seq: str, value: Column, name: str, part: str = "part", size: int = PART,
    width: int = BLOCK,
) -> DataFrame:
    """Ordered array per group, cut into parts of at most ``size`` entries (part 1, 2, …).

    A usual group is part 1 alone; a huge one becomes several rows instead of one unbounded row.
    """
    keys = list(keys)
    ranked = rank_in_groups(df.select(*keys, seq, value.alias("_value")), keys, seq, "_rank", width=width)
    return (
        ranked.withColumn(part, F.expr(f"CAST((_rank - 1) DIV {size} + 1 AS BIGINT)"))
        .groupBy(*keys, part)
        .agg(F.array_sort(F.collect_list(F.struct("_rank", "_value"))).alias("_list"))
        .select(*keys, part, F.transform("_list", lambda x: x["_value"]).alias(name))
    )
