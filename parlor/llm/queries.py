"""Registered queries of the operators, one per operator, over whole tables; their SQL twins are in ``oracles``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import bpe, chat, fingerprint, line_dedup, merkle, minhash, packing, quality, simhash, spelling, substring_dedup, url_filter, warc


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def digest(text) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    out = packing.pack_documents(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", digest(F.col("text")).alias("kept_sha256"))


def op3_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    hard = F.lit(r"\### Assistant: </turn> ok")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), hard.alias("text"))
    turns = table(spark, folder, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(more)
    out = chat.format_conversations(turns).withColumn("turns", chat.parse(F.col("formatted"))).withColumn("loss", chat.under_mask(F.col("formatted"), F.col("mask")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), digest(said).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), digest(F.col("loss")).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


#: Rules of the query: host, path, verdict.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op4_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(map(str, URL_RULES)) + " AS r(host, path, verdict)")
    return url_filter.judge(table(spark, folder, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archive(table(spark, folder, "pages"))


def op6_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    out = bpe.decode(bpe.encode(table(spark, folder, "documents").select("doc_id", "text"), path).select("doc_id", "n_tokens", "ids"), path)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256"))


def op7_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"), width=4)


def op8_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    out = fingerprint.compare_with_edits(table(spark, folder, "documents"))
    return out.select("doc_id", "n_chars", digest(F.col("edited")).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(table(spark, folder, "documents")).select("doc_id", *quality.STATS[:5], "base_failed", "kept")


def op10_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), quality.SPACE + "+"), lambda w: w != "")
    return out.select("doc_id", "n_words", "n_removed", digest(F.array_join(words, " ")).alias("kept_sha256"))


def op11_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"), width=4)


def op12_merkle(spark: SparkSession, folder: str) -> DataFrame:
    tampered = F.when(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    return merkle.manifest(table(spark, folder, "documents"), tampered)


def op13_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_packing, op2_line_dedup, op3_chat_formatting, op4_url_filters, op5_warc, op6_bpe, op7_minhash, op8_fingerprints, op9_quality_rules, op10_substring_dedup, op11_simhash, op12_merkle, op13_spelling)}
