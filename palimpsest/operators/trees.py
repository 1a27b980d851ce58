"""Histories and trees: folds, chains, reachability, version sizes."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` in the folder that spark.checkpoint.dir names; one is made only where none is set and all runs on one machine."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()


def fold(changes: DataFrame, keys: tuple[str, ...] = ("branch", "path"), order: str = "seq") -> DataFrame:
    """Last change of each path by `order`; paths whose last status is D are gone, any other status inserts.

    An aggregate with max_by rather than a window: partial aggregation runs before the
    shuffle, so a path changed in many commits moves one row for each task.
    """
    rest = [c for c in changes.columns if c not in keys]
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("last"))
    return last.where(F.col("last.status") != "D").select(*keys, "last.*")


def version_numbers(commits: DataFrame, by: str = "branch", order: str = "seq") -> DataFrame:
    """`commits` with version, the 1-based rank in append order."""
    return commits.withColumn("version", F.row_number().over(Window.partitionBy(by).orderBy(order)))


def newest(commits: DataFrame, n: int, by: str = "branch", order: str = "seq") -> DataFrame:
    """The newest `n` commits of each group, with nth (1 is the newest). A rank limit, so Spark prunes before the shuffle."""
    ranked = commits.withColumn("nth", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order))))
    return ranked.where(F.col("nth") <= n)


def version_sizes(changes: DataFrame, by: str = "branch", path: str = "path", order: str = "seq") -> DataFrame:
    """Bytes and files of the whole tree at each commit of a linear history; the rows of one commit share its totals.

    A running sum of what each commit adds to its path, not a fold for each commit: linear in the log.
    """
    own = Window.partitionBy(by, path).orderBy(order)
    live = F.when(F.col("status") == "D", 0).otherwise(1)
    now = changes.withColumn("__bytes", F.when(F.col("status") == "D", 0).otherwise(F.col("size"))).withColumn("__files", live)
    step = now.select(
        by,
        order,
        (F.col("__bytes") - F.coalesce(F.lag("__bytes").over(own), F.lit(0))).alias("__bytes"),
        (F.col("__files") - F.coalesce(F.lag("__files").over(own), F.lit(0))).alias("__files"),
    )
    along = Window.partitionBy(by).orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return step.select(by, order, F.sum("__bytes").over(along).alias("tree_bytes"), F.sum("__files").over(along).cast("bigint").alias("tree_files"))


def savings(sizes: DataFrame, changes: DataFrame, by: str = "branch") -> DataFrame:
    """What full copies of every version would take, what distinct contents take, and the difference."""
    naive = sizes.groupBy(by).agg(F.sum("tree_bytes").alias("naive_bytes"))
    objects = changes.where("status <> 'D'").groupBy(by, "content").agg(F.max("size").alias("size"))
    actual = objects.groupBy(by).agg(F.sum("size").alias("actual_bytes"))
    both = naive.join(actual, by, "left").withColumn("actual_bytes", F.coalesce("actual_bytes", F.lit(0)))
    return both.withColumn("saved_bytes", F.greatest(F.lit(0), F.col("naive_bytes") - F.col("actual_bytes")))


def chains(parents: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(start, ancestor): all first-parent ancestors of each start, itself included.

    `parents` is (id, parent). Pointers double each round, so a chain of `depth` commits takes
    log2(depth) joins; then every power of two is applied once, largest first.
    """
    up = checkpointed(parents.where("parent is not null").select("id", "parent"))
    powers = [up]
    while (1 << len(powers)) <= depth:
        last = powers[-1]
        powers.append(checkpointed(last.select(F.col("id"), F.col("parent").alias("mid")).join(last.select(F.col("id").alias("mid"), "parent"), "mid").select("id", "parent")))
    found = starts.select(F.col("id").alias("start"), F.col("id").alias("ancestor"))
    for step in reversed(powers):
        further = found.join(step.select(F.col("id").alias("ancestor"), "parent"), "ancestor").select("start", F.col("parent").alias("ancestor"))
        found = checkpointed(found.unionByName(further))  # else the plan would double with each round
    return found


def first_parents(parents: DataFrame, tip: object) -> DataFrame:
    """(start, ancestor): the first-parent ancestors of one commit; pointers double until a round adds nothing."""
    spark, kind = parents.sparkSession, parents.schema["id"].dataType.simpleString()
    found = checkpointed(spark.createDataFrame([(tip, tip)], f"start {kind}, ancestor {kind}"))
    step = checkpointed(parents.where("parent is not null").select("id", "parent"))
    while True:
        further = found.join(step.select(F.col("id").alias("ancestor"), "parent"), "ancestor").select("start", F.col("parent").alias("ancestor"))
        further = checkpointed(further)
        if further.isEmpty():
            return found
        found = checkpointed(found.unionByName(further))
        step = checkpointed(step.select("id", F.col("parent").alias("mid")).join(step.select(F.col("id").alias("mid"), "parent"), "mid").select("id", "parent"))


def numbered(rows: DataFrame, order: str, name: str = "version") -> DataFrame:
    """`rows` with their place by `order` from 1 on: ranges are sorted in tasks of their own, and the rows before each range are added."""
    ranged = rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("__part", F.spark_partition_id())
    ranged = checkpointed(ranged)
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect()  # one row a partition
    before, total = {}, 0
    for part, n in sorted((r["__part"], r["n"]) for r in sizes):
        before[part], total = total, total + n
    starts = rows.sparkSession.createDataFrame(list(before.items()), "__part int, __before long")
    nth = F.row_number().over(Window.partitionBy("__part").orderBy(order))
    return ranged.join(F.broadcast(starts), "__part").withColumn(name, F.col("__before") + nth).drop("__part", "__before")


def ancestors(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, ancestor) over all parents of a DAG, itself included; a parent without a row of its own counts too.

    `edges` is (id, parent), one row a parent. Only the newest layer is joined; what was seen is removed.
    """
    edges = checkpointed(edges.where("parent is not null").select(F.col("id").alias("ancestor"), "parent").distinct())
    found = layer = checkpointed(starts.select(F.col("id").alias("start"), F.col("id").alias("ancestor")).distinct())
    while not layer.isEmpty():
        reached = layer.join(edges, "ancestor").select("start", F.col("parent").alias("ancestor")).distinct()
        layer = checkpointed(reached.join(found, ["start", "ancestor"], "left_anti"))
        found = checkpointed(found.unionByName(layer))
    return found


def lineages(forks: DataFrame, tips: DataFrame) -> DataFrame:
    """(start, segment, upto): the stretches of linear history that reach each tip, the tip's own first.

    `forks` is (segment, parent_segment, fork), one row for each segment that forks off another; `tips` is
    (start, segment, upto). Whole stretches move, not commits, and a round goes up one fork.
    """
    forks = checkpointed(forks)
    found = layer = checkpointed(tips.select("start", "segment", "upto"))
    while not layer.isEmpty():
        layer = checkpointed(layer.join(forks, "segment").select("start", F.col("parent_segment").alias("segment"), F.col("fork").alias("upto")))
        found = found.unionByName(layer)
    return found


def merge_bases(pairs: DataFrame, lineage: DataFrame) -> DataFrame:
    """`pairs` (left, right) with base, the last common ancestor in append order, and fast_forward.

    `lineage` is (start, segment, upto) with commit ids that grow in append order; what two lineages share of
    a segment ends at the lesser end.
    """
    left = lineage.select(F.col("start").alias("left"), "segment", F.col("upto").alias("__l"))
    right = lineage.select(F.col("start").alias("right"), "segment", F.col("upto").alias("__r"))
    shared = pairs.join(left, "left").join(right, ["right", "segment"])
    common = shared.groupBy("left", "right").agg(F.max(F.least("__l", "__r")).alias("base"))
    return pairs.join(common, ["left", "right"], "left").withColumn("fast_forward", F.coalesce(F.col("base") == F.col("left"), F.lit(False)))
