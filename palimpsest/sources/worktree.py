"""A working tree as a table: listed on the driver, hashed in tasks, hidden files included."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import labels

LISTED = "path string, size long, mtime_ns long"
STORE = ".store"


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, mtime_ns) of every file below `root` but its store; names that begin with a dot count."""
    rows = []
    for folder, folders, names in os.walk(root):
        folders[:] = sorted(f for f in folders if not (folder == root and f == STORE))
        for name in sorted(names):
            full = os.path.join(folder, name)
            info = os.stat(full)
            rows.append((os.path.relpath(full, root).replace(os.sep, "/"), info.st_size, info.st_mtime_ns))
    return spark.createDataFrame(rows, LISTED)


def candidates(listed: DataFrame, tracked: DataFrame) -> DataFrame:
    """Files to look at: all tracked ones, and others of a supported kind."""
    known = listed.join(tracked.select("path"), "path", "left_semi")
    new = listed.join(tracked.select("path"), "path", "left_anti").where(labels.supported(F.col("path")))
    return known.unionByName(new)


def hashed(files: DataFrame, root: str) -> DataFrame:
    """`files` (path, ...) with content, the SHA-256 of their bytes; the tree must be mounted where tasks run."""
    columns = files.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            digests = []
            for path in batch["path"]:
                with open(os.path.join(root, path), "rb") as f:
                    digests.append(hashlib.file_digest(f, "sha256").hexdigest())
            yield batch.assign(content=digests)

    return files.mapInPandas(run, files.selectExpr(*columns, "cast(null as string) as content").schema)
