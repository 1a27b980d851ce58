"""State files of a repository: configuration, commit log, branches, stashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILE = "struct<path: string, status: string, content: string, isKra: boolean, fileHash: string, originalSize: long>"
COMMIT = f"id string, hash string, message string, author string, timestamp string, parents array<string>, branch string, restoredFrom string, files array<{FILE}>"
CONFIG = "version int, deltaChainMax int, tileSize int, cacheMaxBytes long, tilePixelDeltas boolean, lowMemoryDiff boolean"
OLD_CACHE, NEW_CACHE = 512 << 20, 256 << 20  # the default of version 1 and of version 2


def commits(spark: SparkSession, path: str) -> DataFrame:
    """(seq, commit fields): JSON lines up to the first bad one. A torn line ends the log, it is not skipped.

    Lines are numbered in file order, which is append order, so the log must be one file.
    """
    lines = spark.read.schema(f"{COMMIT}, __bad string").option("columnNameOfCorruptRecord", "__bad").json(path)
    numbered = lines.select("*", F.monotonically_increasing_id().alias("seq"))
    bad = numbered.where(F.col("__bad").isNotNull() | F.col("id").isNull()).agg(F.min("seq").alias("__end"))
    kept = numbered.crossJoin(F.broadcast(bad)).where("__end is null or seq < __end")  # one row
    return kept.drop("__bad", "__end").withColumn("files", F.coalesce("files", F.array().cast(f"array<{FILE}>"))).withColumn("parents", F.coalesce("parents", F.array().cast("array<string>")))


def legacy_commits(spark: SparkSession, path: str) -> DataFrame:
    """The log of old repositories: one JSON array."""
    rows = spark.read.schema(f"{COMMIT}").option("multiLine", True).json(path)
    return rows.withColumn("seq", F.monotonically_increasing_id())


def changed_files(log: DataFrame) -> DataFrame:
    """One row for each file of each commit, with its place in the commit."""
    return log.select("seq", F.col("id").alias("commit_id"), "branch", F.posexplode("files").alias("file_pos", "f")).select("seq", "commit_id", "branch", "file_pos", "f.*")


def config(spark: SparkSession, path: str) -> DataFrame:
    """The configuration with defaults; the old default cache size becomes the new one, a size of one's own stays."""
    row = spark.read.schema(CONFIG).option("multiLine", True).json(path)
    migrated = F.when((F.coalesce("version", F.lit(1)) < 2) & (F.coalesce("cacheMaxBytes", F.lit(OLD_CACHE)) == OLD_CACHE), NEW_CACHE).otherwise(F.col("cacheMaxBytes"))
    return row.select(
        F.lit(2).alias("version"),
        F.coalesce("deltaChainMax", F.lit(20)).alias("deltaChainMax"),
        F.coalesce("tileSize", F.lit(64)).alias("tileSize"),
        F.coalesce(migrated, F.lit(NEW_CACHE)).cast("long").alias("cacheMaxBytes"),
        F.coalesce("tilePixelDeltas", F.lit(False)).alias("tilePixelDeltas"),
        F.coalesce("lowMemoryDiff", F.lit(False)).alias("lowMemoryDiff"),
    )


def branches(spark: SparkSession, path: str, log: DataFrame | None = None) -> DataFrame:
    """(name, tip, is_current): an empty tip is null. Without the file, a branch main at the last commit of `log`."""
    if path:
        state = spark.read.schema("current string, tips map<string, string>").option("multiLine", True).json(path)
        return state.select("current", F.explode("tips").alias("name", "tip")).select("name", F.expr("nullif(tip, '')").alias("tip"), (F.col("name") == F.col("current")).alias("is_current"))
    return log.agg(F.max_by("id", "seq").alias("tip")).select(F.lit("main").alias("name"), "tip", F.lit(True).alias("is_current"))


SAMPLES = "op string, ms double, ts long, commitId string"


def samples(spark: SparkSession, path: str) -> DataFrame:
    """(op, ms, ts, commit_id): timing samples, one JSON array a file; what is no such array has none."""
    read = spark.read.schema(SAMPLES).option("multiLine", True).json(path)
    return read.where("op is not null and ms is not null").withColumnRenamed("commitId", "commit_id")
