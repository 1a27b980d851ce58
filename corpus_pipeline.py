"""A training-data pipeline over `documents`: five stages, each on all that the one before kept.

Edge cases, in every stage: null ids, texts and other columns stay as they are; empty and very long texts are texts like any
other; rows that repeat are judged alike, and of near-duplicates, repeats included, exactly one row stays, ties going to the
smallest id and then to the smallest hash; an empty table gives an empty one; other columns, whatever their names, are carried on.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import bpe, decontamination, simhash, suffix_dedup, toxicity
from palimpsest.llm.common import cut_lineage, removed, row_identity, table, written_at
from palimpsest.llm.queries import fold


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold stay."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), fold("doc_id", 3) != 1)
    return toxicity.reject(docs, model)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row stays of each group of near-duplicates: that of the smallest id, null last, and then of the smallest hash of id and text."""
    rows = docs.withColumn("__row", row_identity("doc_id", "text"))  # a name that documents do not have
    whole = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col("__row").alias("row"))
    found = simhash.near_duplicates(rows.select(whole.alias("__whole"), "text"), "__whole")
    kept = found.where("__whole <=> component").groupBy(F.col("__whole.row").alias("__row")).agg(F.count(F.lit(1)).alias("n_rows"))
    kept = cut_lineage(kept)
    once = rows.join(kept.where("n_rows = 1"), "__row", "left_semi").select(*docs.columns)
    again = rows.join(kept.where("n_rows > 1"), "__row", "left_semi")
    first = again.groupBy("__row").agg(F.min(F.struct(*docs.columns)).alias("first")).select("first.*")
    return once.unionByName(first)


def strip_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings that occur elsewhere too are cut out of the texts; every document stays."""
    return suffix_dedup.strip(docs).withColumn("n_chars", F.char_length(F.coalesce("text", F.lit(""))).cast("long")).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word window of a test item stay."""
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts, and digests of the ids and of what they decode to."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.round_trip(docs, ranks, public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash", keep_one_of_each),
    ("suffix_array", strip_repeats),
    ("decontamination", decontaminate),
    ("byte_bpe", encode),
]

#: The stages train, link and replay: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage before it is written as Parquet and read again, and the one before that removed."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = written_at(stage(spark, docs, sf_dir), name)
        if before:
            removed(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
