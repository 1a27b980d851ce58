"""The commit log as a stream: one JSON file a commit, a live tree, and progressive layer results."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

COMMIT = "seq long, branch string, message string, timestamp string, files array<struct<path: string, status: string, content: string, size: long>>"
CHANGE = "branch string, path string, seq long, status string, content string, size long"
#: How often a working tree is polled.
POLL = "1500 milliseconds"


def append_commit(folder: str, commit: dict) -> str:
    """Writes one commit as a file of its own: a file source does not see what is added to a file it has read."""
    os.makedirs(folder, exist_ok=True)
    name = f"{commit['seq']:012d}-{uuid.uuid4().hex}.json"
    temporary = os.path.join(folder, f".{name}.tmp")
    with open(temporary, "w") as out:
        json.dump(commit, out)
    os.replace(temporary, os.path.join(folder, name))
    return name


def commits(spark: SparkSession, folder: str) -> DataFrame:
    """The stream of commits in a folder of JSON files."""
    return spark.readStream.schema(COMMIT).json(folder)


def changes(log: DataFrame) -> DataFrame:
    """One row for each changed path, of a stream or a table of commits."""
    return log.select("seq", "branch", F.explode("files").alias("f")).select("branch", F.col("f.path").alias("path"), "seq", F.col("f.status").alias("status"), F.col("f.content").alias("content"), F.col("f.size").alias("size"))


def live_tree(stream: DataFrame) -> DataFrame:
    """Each change that moves a path on, keyed by (branch, path); a change older than what is known is passed over."""

    def move(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else None
        rows = pd.concat(batches, ignore_index=True).sort_values("seq")
        last = rows.iloc[[-1]]
        if seen is None or int(last["seq"].iloc[0]) > seen:
            state.update((int(last["seq"].iloc[0]),))
            yield last[["branch", "path", "seq", "status", "content", "size"]]

    return stream.groupBy("branch", "path").applyInPandasWithState(move, CHANGE, "seq long", "update", GroupStateTimeout.NoTimeout)


def start_live_tree(spark: SparkSession, folder: str, name: str, checkpoint: str) -> StreamingQuery:
    """Keeps the newest change of each path in a memory table of moves."""
    query = live_tree(changes(commits(spark, folder))).writeStream.outputMode("update").format("memory").queryName(name)
    return query.option("checkpointLocation", checkpoint).trigger(processingTime=POLL).start()


def upsert_layers(batch: DataFrame, target: str) -> None:
    """foreachBatch sink: the newest result of each layer id replaces the one before, in whatever order they come.

    `target` is a view of the newest version, a table of its own; the view moves to a finished table in one step, so a crash
    leaves the version before.
    """
    spark = batch.sparkSession
    newest = batch.groupBy("id").agg(F.max_by(F.struct(*[c for c in batch.columns if c != "id"]), "done").alias("r")).select("id", "r.*")
    version, before = f"{target}_{uuid.uuid4().hex[:12]}", None
    if spark.catalog.tableExists(target):
        before = spark.sql(f"DESCRIBE EXTENDED {target}").where("col_name = 'View Text'").first()["data_type"].split()[-1]
        known = spark.table(target)
        both = known.unionByName(newest).groupBy("id").agg(F.max_by(F.struct(*[c for c in known.columns if c != "id"]), "done").alias("r"))
        newest = both.select("id", "r.*")
    newest.write.saveAsTable(version)
    spark.sql(f"CREATE OR REPLACE VIEW {target} AS SELECT * FROM {version}")
    if before:
        spark.sql(f"DROP TABLE IF EXISTS {before}")
