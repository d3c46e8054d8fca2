"""Line deduplication over levelled sorted runs of line hashes.

Documents come in batches of descending ``doc_id``. A run is a table bucketed and sorted by the hash of the line key, so that a batch meets it in
a merge join that moves only the batch. Each batch anti-joins the runs: keys they lack are new, and as later batches hold smaller ids only, the
batch's largest document with the key is its keeper. Keys they have add to the count. Both become a run of level 0; ``fanout`` runs of a level are
compacted into one of the next. In the end the runs give, for each key, the number of documents and the keeper. DataFrame functions only.

Null text: one empty line. Null ``doc_id``: sorts below all ids. Rows of one ``doc_id``: one document. Extra columns are passed on.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from .store import is_empty, new_path, stored

MIN_LENGTH, MIN_DOCS = 40, 5
BATCHES, FANOUT = 4, 2
_BLANK = " \t\n\x0b\f\r"
_HASH = ("h1", "h2")


def ascii_lower(text: Column) -> Column:
    """Lower case for A-Z alone; the built-in function does just that where all is ASCII."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def line_key(line: Column) -> Column:
    return ascii_lower(F.trim(line, F.lit(_BLANK)))


def line_hash(line: Column) -> Column:
    """128 bits of the key, or null for a key too short to count."""
    key = line_key(line)
    pair = F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2"))
    return F.when(F.length(F.trim(line, F.lit(_BLANK))) >= MIN_LENGTH, pair)


class Runs:
    """Levels of runs; a run has the columns h1, h2, docs (documents counted) and keeper (null where an older run has it)."""

    def __init__(self, spark, buckets: int, fanout: int = FANOUT):
        self.spark, self.buckets, self.fanout, self.levels = spark, buckets, fanout, []

    def all(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def _write(self, rows: DataFrame) -> DataFrame:
        name = f"line_run_{uuid.uuid4().hex}"
        (rows.repartition(self.buckets, *_HASH).write.format("parquet").option("compression", "zstd").option("path", new_path(self.spark, name))
         .bucketBy(self.buckets, *_HASH).sortBy(*_HASH).saveAsTable(name))
        return self.spark.table(name)

    def add(self, batch: DataFrame) -> None:
        """batch: distinct (h1, h2, doc_id)."""
        own = batch.groupBy(*_HASH).agg(F.count("*").alias("docs"), F.max("doc_id").alias("last"))
        fresh = own
        for run in self.all():
            fresh = fresh.join(run.select(*_HASH), list(_HASH), "left_anti")
        # a key that a run has keeps that run's keeper: only its count is added
        new = fresh.select(*_HASH, F.lit(True).alias("new"))
        rows = own.join(new, list(_HASH), "left").select(*_HASH, "docs", F.when(F.col("new"), F.col("last")).alias("keeper")) if self.levels else own.withColumnRenamed("last", "keeper")
        self._push(self._write(rows), 0)

    def _push(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            merged, self.levels[level] = self._write(merge(self.levels[level])), []
            self._push(merged, level + 1)


def merge(runs: list[DataFrame]) -> DataFrame:
    """One row per key: counts added; exactly one run has the keeper of a key."""
    rows = runs[0]
    for run in runs[1:]:
        rows = rows.unionByName(run)
    return rows.groupBy(*_HASH).agg(F.sum("docs").alias("docs"), F.max("keeper").alias("keeper"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """The documents with ``text`` less the lines dropped, and ``n_lines`` (before) and ``n_dropped``."""
    spark = docs.sparkSession
    ident = F.coalesce(F.col(key), F.lit(-(1 << 63)))
    split = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    same = F.xxhash64(text)  # rows of one id may differ in text
    cuts = docs.agg(F.percentile_approx(ident, [i / batches for i in range(1, batches)], 1000).alias("c")).collect()[0]["c"] or []
    batch = sum((F.when(F.col("doc_id") < c, 1).otherwise(0) for c in sorted(set(cuts))), F.lit(0))
    found = docs.select(ident.alias("doc_id"), same.alias("same"), F.posexplode(F.transform(split, line_hash)).alias("pos", "h")).where("h IS NOT NULL")
    lines = stored(found.select("h.h1", "h.h2", "doc_id", "same", "pos", batch.alias("batch")), "lines")
    runs = Runs(spark, int(spark.conf.get("spark.sql.shuffle.partitions")))
    for b in range(len(cuts) + 1):
        own = lines.where(F.col("batch") == b).select(*_HASH, "doc_id").distinct()
        if not is_empty(own):
            runs.add(own)
    if not runs.levels:
        return docs.withColumns({"n_lines": F.size(split).cast("long"), "n_dropped": F.lit(0).cast("long"), text: F.coalesce(F.col(text), F.lit(""))})
    frequent = merge(runs.all()).where(F.col("docs") >= min_docs)
    drops = (lines.join(frequent, list(_HASH)).where(F.col("doc_id") != F.col("keeper"))
             .groupBy(F.col("doc_id").alias("_doc"), F.col("same").alias("_same")).agg(F.collect_set("pos").alias("_drop")))
    joined = docs.withColumns({"_lines": split, "_ident": ident}).join(drops, (F.col("_ident") == F.col("_doc")) & (same == F.col("_same")), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_drop")
    left = F.when(F.col("_drop").isNull(), F.col("_lines")).otherwise(F.transform(stay, lambda i: F.get("_lines", i)))
    return joined.withColumn("_left", left).withColumns({
        text: F.array_join("_left", "\n"), "n_lines": F.size("_lines").cast("long"), "n_dropped": (F.size("_lines") - F.size("_left")).cast("long"),
    }).drop("_lines", "_ident", "_doc", "_same", "_drop", "_left")
