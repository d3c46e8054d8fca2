r"""Conversations as training text, proved by a grammar round trip.

Template: each turn is ``### role: body</turn>`` and a line end. The parser is deterministic: blocks end at ``</turn>`` and a line end; a block is the mark, a role up to the
first ``: ``, and a body without marks, in which a backslash stands for the character after it; role and body do not end in half an escape. A turn is first rendered as it is and parsed again; if that
does not give back the turn, its control strings get a backslash inside (``<\/turn>``, ``#\## ``, ``\\``). Then the whole conversation is parsed; if the
turns differ from the source, all are escaped. An escaped body holds no control string, so this is the last step. DataFrame functions only.

The loss mask has one entry per block: characters to skip, characters of the body, and whether the loss counts (assistant turns). A conversation is
one row by its nature; all else is done per turn. Null text or role: empty. Null conversation: one of its own. Rows of one turn: ordered by role and
text, all kept. Extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

MARK, SEPARATOR, END, ASSISTANT = "### ", ": ", "</turn>", "assistant"
_STOP = END + "\n"


def escape(body: Column) -> Column:
    return F.replace(F.replace(F.replace(body, F.lit("\\"), F.lit("\\\\")), F.lit(END), F.lit("<\\/turn>")), F.lit(MARK), F.lit("#\\## "))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(SEPARATOR), F.lit(":\\ "))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def half_escape(text: Column) -> Column:
    """Whether the last character is a backslash that no backslash before it takes."""
    return F.endswith(text, F.lit("\\")) & F.regexp_like(text, F.lit(r"(?<!\\)\\(\\\\)*$"))


def render(role: Column, body: Column) -> Column:
    return F.concat(F.lit(MARK), role, F.lit(SEPARATOR), body, F.lit(_STOP))


def blocks(formatted: Column) -> Column:
    """Blocks without their ends; what follows the last end comes last."""
    return F.split(formatted, _STOP, -1)


def parse(formatted: Column) -> Column:
    """Turns (role, text) of a rendered text, or null if it is not in the grammar."""

    def turn(block: Column) -> Column:
        at = F.locate(SEPARATOR, block)
        body = F.substring(block, at + len(SEPARATOR), F.length(block))
        role = F.substring(block, F.lit(len(MARK) + 1), at - len(MARK) - 1)
        ok = F.startswith(block, F.lit(MARK)) & (at > 0) & ~F.contains(body, F.lit(MARK)) & ~F.contains(body, F.lit(END)) & ~half_escape(body) & ~half_escape(role)
        return F.when(ok, F.struct(unescape(role).alias("role"), unescape(body).alias("text")))

    parts = blocks(formatted)
    turns = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), turn)
    return F.when((F.get(parts, F.size(parts) - 1) == "") & ~F.exists(turns, lambda x: x.isNull()), turns)


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per conversation: conv, formatted and mask (array of skip, take, loss)."""
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    source = F.array(F.struct("role", "text"))
    conflict = ~F.coalesce(parse(render(F.col("role"), F.col("text"))) == source, F.lit(False))
    rows = rows.withColumn("bad", conflict)
    safe = F.struct(escape_role(F.col("role")).alias("r"), escape(F.col("text")).alias("b"))
    shown = F.when(F.col("bad"), safe).otherwise(F.struct(F.col("role").alias("r"), F.col("text").alias("b")))
    rows = rows.select("conv", F.struct("turn", "role", "text", shown.alias("shown"), safe.alias("safe")).alias("x"))
    whole = rows.groupBy("conv").agg(F.sort_array(F.collect_list("x")).alias("x"))

    def rendered(which: str) -> Column:
        return F.array_join(F.transform("x", lambda t: render(t[which]["r"], t[which]["b"])), "")

    whole = whole.withColumn("first", rendered("shown"))
    same = F.coalesce(parse(F.col("first")) == F.transform("x", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))), F.lit(False))
    whole = whole.withColumn("same", same).withColumn("formatted", F.when(F.col("same"), F.col("first")).otherwise(rendered("safe")))

    def entry(t: Column) -> Column:
        r, b = (F.when(F.col("same"), t["shown"][c]).otherwise(t["safe"][c]) for c in "rb")
        return F.struct((len(MARK) + F.length(r) + len(SEPARATOR)).alias("skip"), F.length(b).alias("take"), (t["role"] == ASSISTANT).alias("loss"))

    return whole.select(F.col("conv").alias(conv), "formatted", F.transform("x", entry).alias("mask"))


def under_mask(formatted: Column, mask: Column) -> Column:
    """Text under the loss mask, unescaped, turn after turn."""
    pairs = F.arrays_zip(mask.alias("m"), F.slice(blocks(formatted), F.lit(1), F.size(mask)).alias("b"))
    return F.array_join(F.transform(F.filter(pairs, lambda p: p["m"]["loss"]), lambda p: unescape(F.substring(p["b"], p["m"]["skip"] + 1, p["m"]["take"]))), "")
