"""URL rules by hashed expressions.

A rule is a host and a path prefix. Rules have few shapes (labels of the host, characters of the path); a URL is expanded into one expression per shape
that fits it: so many last labels of its host and so many first characters of its path. Expressions meet the rules in an equi-join on the first 32
bits of a SHA-256; full digests confirm, then the longest rule wins (of equal length: the longer host, block before allow, the smaller text).
Each distinct URL is judged once, so copies cost one look-up. DataFrame functions only; rules may be a table of any size, with few shapes.

Null URL or one without ``://``: empty host and path, which no rule fits. No rule: ``default``. Extra columns are passed on; columns of the names
added here are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .line_dedup import ascii_lower

DEFAULT = "allow"
SHORT = 8


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def labels(host: Column) -> Column:
    return F.split(host, r"\.", -1)


def expressions(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """One expression per shape that fits, null for others."""
    parts = labels(host)
    each = [F.when((F.size(parts) >= n) & (F.length(path) >= m), F.concat(F.array_join(F.slice(parts, -n, n), "."), F.substring(path, 1, m))) for n, m in shapes]
    return F.array_compact(F.array(*each)) if each else F.array().cast("array<string>")


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT) -> DataFrame:
    """pages with host, path, rule and verdict. rules: host, path, verdict."""
    named = rules.select(ascii_lower(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"), "verdict").withColumn("rule", F.concat("rule_host", "rule_path"))
    shape = F.struct(F.size(labels(F.col("rule_host"))).alias("n"), F.length("rule_path").alias("m"))
    shapes = [(r["x"]["n"], r["x"]["m"]) for r in named.select(shape.alias("x")).distinct().collect()]  # a few, however many rules
    keyed = named.withColumn("full", F.sha2("rule", 256)).withColumn("short", F.substring("full", 1, SHORT))
    host, path = host_and_path(F.col("_url"))
    found = pages.select(F.col(url).alias("_url")).distinct().select("_url", F.explode(expressions(host, path, sorted(shapes))).alias("expression"))
    hashed = found.withColumn("digest", F.sha2("expression", 256)).withColumn("short", F.substring("digest", 1, SHORT))
    rank = F.struct(F.length("rule").alias("l"), F.length("rule_host").alias("h"), (F.col("verdict") == "block").alias("b"), F.col("rule").alias("_rule"), F.col("verdict").alias("_verdict"))
    best = hashed.join(keyed, "short").where("digest = full").groupBy("_url").agg(F.max(rank).alias("x")).select("_url", "x._rule", "x._verdict")
    own_host, own_path = host_and_path(F.col(url))
    out = pages.join(best, F.col(url) == F.col("_url"), "left").withColumns({"host": own_host, "path": own_path, "rule": F.col("_rule"), "verdict": F.coalesce("_verdict", F.lit(default))})
    return out.drop("_url", "_rule", "_verdict")
