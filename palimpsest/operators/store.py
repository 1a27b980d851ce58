"""The object store as relations: chains, attribution, liveness, packs and caches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Patches after a snapshot before the next snapshot.
MOST_PATCHES = 20


def distinct_versions(versions: DataFrame, stream: str = "stream", content: str = "content", order: str = "seq") -> DataFrame:
    """First version of each content in a stream: content that is anywhere in the chain is not stored again."""
    rest = [c for c in versions.columns if c not in (stream, content)]
    first = versions.groupBy(stream, content).agg(F.min_by(F.struct(*rest), F.col(order)).alias("v"))
    return first.select(stream, content, "v.*")


def chain_lengths(versions: DataFrame, eligible: Column, stream: str = "stream", order: str = "seq", most: int = MOST_PATCHES) -> DataFrame:
    """`versions` with chain_len: 0 for a snapshot, one more for each patch on it.

    A version that may not be a patch starts a run; within a run every (most + 1)th is a snapshot.
    """
    along = Window.partitionBy(stream).orderBy(order)
    run = F.sum(F.when(eligible, 0).otherwise(1)).over(along.rowsBetween(Window.unboundedPreceding, 0))
    marked = versions.withColumn("__run", run)
    nth = F.row_number().over(Window.partitionBy(stream, "__run").orderBy(order)) - 1
    return marked.withColumn("chain_len", (nth % (most + 1)).cast("int")).drop("__run")


def attributed_bytes(references: DataFrame, sizes: DataFrame, by: str) -> DataFrame:
    """Bytes of objects by the group that refers to each first: references are (object, order, by), sizes (object, size).

    An object without a size counts as nothing.
    """
    first = references.groupBy("object").agg(F.min_by(by, "order").alias(by))
    return first.join(sizes, "object", "left").groupBy(by).agg(F.coalesce(F.sum("size"), F.lit(0)).alias("stored_bytes"), F.count(F.lit(1)).alias("objects"))


def dead(objects: DataFrame, live: DataFrame, key: str = "object") -> DataFrame:
    """Objects that nothing live refers to."""
    return objects.join(live.select(key).distinct(), key, "left_anti")


def prune(entries: DataFrame, budget: Column, by: str, order: list[str], size: str = "size") -> DataFrame:
    """Entries to delete, oldest first, until what is left fits the budget."""
    own = Window.partitionBy(by)
    before = F.sum(size).over(own.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    marked = entries.withColumn("__total", F.sum(size).over(own)).withColumn("__gone", F.coalesce(before, F.lit(0)))
    return marked.where(F.col("__total") - F.col("__gone") > budget).drop("__total", "__gone")


def worth_rewriting(dead_bytes: Column, all_bytes: Column) -> Column:
    """A pack is rewritten when over a quarter of it is dead."""
    return (dead_bytes > 0) & (dead_bytes * 4 > all_bytes)


def consolidated(packs: DataFrame, most_bytes: int = 4 << 20, least_packs: int = 8, by: str | None = None) -> DataFrame:
    """Small packs to merge, where there are enough of them."""
    small = packs.where(F.col("bytes") <= most_bytes)
    key = F.col(by) if by else F.lit(0)
    enough = small.groupBy(key.alias("__by")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_packs).select("__by")
    return small.withColumn("__by", key).join(enough, "__by", "left_semi").drop("__by")


def retained(rows: DataFrame, by: str, order: str, size: str, budget: int) -> DataFrame:
    """`rows` with kept: greedy by order, a row that does not fit is skipped and later ones may still fit.

    Whether a row fits depends on all before it, so a group goes through one task, but row by row: what is held is one sum.
    """
    schema = rows.select("*", F.lit(True).alias("kept")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, used = None, 0
        for batch in batches:
            kept = []
            for key, n in zip(batch[by].tolist(), batch[size].tolist(), strict=True):
                if key != group:
                    group, used = key, 0
                kept.append(used + n <= budget)
                used += n * kept[-1]
            yield batch.assign(kept=kept)

    return rows.repartition(by).sortWithinPartitions(by, order).mapInPandas(run, schema)
