"""Documents to packed training sequences in five stages; each is written as Parquet and read again before the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from parlor.llm import line_dedup, minhash, packing, quality, substring_dedup
from parlor.llm.store import new_path

Docs = DataFrame


def _as_documents(out: DataFrame, docs: DataFrame) -> DataFrame:
    """Columns of ``docs``, with the length of the new text."""
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out.select(*docs.columns)


def quality_rules(spark: SparkSession, docs: Docs, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the thresholds of their source and language; null and blank texts go, nulls in other columns are groups of their own."""
    return quality.filter_documents(docs)


def dedup_lines(spark: SparkSession, docs: Docs, sf_dir: str) -> DataFrame:
    """All rows, their texts without the lines that later documents hold; null text becomes empty, an empty table stays empty."""
    return _as_documents(line_dedup.dedup_lines(docs), docs)


def near_duplicates(spark: SparkSession, docs: Docs, sf_dir: str) -> DataFrame:
    """One row of each group stays: that of least id, rows without id last; of equal rows one. Rows without words all stay."""
    return minhash.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: Docs, sf_dir: str) -> DataFrame:
    """All rows, their texts without passages that a document of smaller id holds."""
    return _as_documents(substring_dedup.remove_repeats(docs), docs)


def packed(spark: SparkSession, docs: Docs, sf_dir: str) -> DataFrame:
    """Pieces of token sequences; see ``packing``."""
    out = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("packing", packed),
]

#: Tokens and similarity groups have no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents; an empty table gives no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"stage_{name}")
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
    return docs
