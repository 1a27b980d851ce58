"""The queries of the numbered operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import bpe, decontamination, html_extraction, language_id, oracles, perplexity, sharding, simhash, suffix_dedup, toxicity, warc
from palimpsest.llm.common import table, written


def fold(id_col: str, parts: int) -> Column:
    """The part of a held-out split that an id belongs to."""
    return F.crc32(F.col(id_col).cast("string")) % parts


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        decontamination.digest(F.col("items")).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op2_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", *perplexity.COUNTS, "base_failed", "kept", "log_perplexity", "lower", "upper"
    )


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.round_trip(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op5_tag_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extraction.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = written(warc.archives(table(spark, sf_dir, "pages")), "warc")
    return warc.read(stored).select(
        F.col("page_id").cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.predict(docs, language_id.train(docs, fold("doc_id", 4) != 2))
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op8_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicate(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, fold("doc_id", 3) != 1)
    return toxicity.score(docs, model).select(
        "doc_id",
        (fold("doc_id", 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (op1_decontamination, op2_perplexity, op3_byte_bpe, op4_sharding, op5_tag_paths, op6_warc, op7_language_id, op8_suffix_array, op9_toxicity, op10_simhash)
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": oracles.DECONTAMINATION, "op6_warc": oracles.WARC, "op8_suffix_array": oracles.SUFFIX_ARRAY}
