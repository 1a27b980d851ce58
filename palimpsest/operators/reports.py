"""Reports: timings, version cards, garbage, the commit graph's links and lanes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Colours that branches take in turn.
COLOURS = 4


def timing_summary(samples: DataFrame) -> DataFrame:
    """Samples and mean milliseconds of each operation."""
    return samples.groupBy("op").agg(F.count(F.lit(1)).alias("samples"), F.avg("ms").alias("mean_ms"))


def timing_by_commit(samples: DataFrame) -> DataFrame:
    """(commit_id, save_ms, compare_ms): the latest commit and diff times.

    A merge or rollback fills the save time only where no commit sample did, and the first one does.
    """
    is_ = lambda *ops: F.col("op").isin(*ops)
    latest = lambda op: F.max_by(F.when(is_(op), F.col("ms")), F.when(is_(op), F.col("ts")))
    first = F.min_by(F.when(is_("merge", "rollback"), F.col("ms")), F.when(is_("merge", "rollback"), F.col("ts")))
    found = samples.where("commit_id is not null").groupBy("commit_id").agg(latest("commit").alias("c"), first.alias("m"), latest("diff").alias("compare_ms"))
    return found.select("commit_id", F.coalesce("c", "m").alias("save_ms"), "compare_ms").where("save_ms is not null or compare_ms is not null")


def revert_links(commits: DataFrame) -> DataFrame:
    """(commit, row, target_row): commits that restore another one, with both rows."""
    target = commits.select(F.col("id").alias("restored_from"), F.col("row").alias("target_row"))
    return commits.where("restored_from is not null").join(target, "restored_from").select(F.col("id").alias("commit"), "row", "target_row")


def tips_by_commit(branches: DataFrame) -> DataFrame:
    """(tip, branches): the names of the branches at each tip, sorted and joined by a comma."""
    return branches.where("tip is not null").groupBy("tip").agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("branches"))


def branch_colours(commits: DataFrame, current: object, repo: str = "repo") -> DataFrame:
    """(repo, branch, colour): the current branch first, then by first appearance, in COLOURS turns."""
    first = commits.groupBy(repo, "branch").agg(F.min("seq").alias("first"))
    order = Window.partitionBy(repo).orderBy(F.when(F.col("branch") == current, 0).otherwise(1), "first", "branch")
    return first.select(repo, "branch", ((F.row_number().over(order) - 1) % COLOURS).alias("colour"))


def lanes(commits: DataFrame) -> DataFrame:
    """(repo, id, row, lane): the lane of each commit in a history drawn newest first.

    `commits` is (repo, seq, id, parents). A commit takes the leftmost lane that waits for it, or a free
    one; its first parent goes on in that lane, other parents in a lane that waits for them or a free one. Which lane is
    free depends on all rows before, so a repository is one group.
    """
    return commits.groupBy("repo").applyInPandas(_lanes, "repo long, id long, row long, lane long")


def _lanes(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("seq", ascending=False)
    waiting: list[object] = []
    out = []

    def take(wanted: object) -> int:
        k = next((k for k, w in enumerate(waiting) if w is None), len(waiting))
        waiting[k : k + 1] = [wanted]
        return k

    for row, (ident, parents) in enumerate(zip(rows["id"], rows["parents"], strict=True)):
        lane = next((k for k, w in enumerate(waiting) if w == ident), None)
        lane = take(ident) if lane is None else lane
        waiting[:] = [None if w == ident else w for w in waiting]
        for k, parent in enumerate(parents):
            if k == 0:
                waiting[lane] = parent
            elif parent not in waiting:
                take(parent)
        out.append((ident, row, lane))
    found = pd.DataFrame(out, columns=["id", "row", "lane"])
    found.insert(0, "repo", rows["repo"].iloc[0])
    return found


def garbage(objects: DataFrame, reachable: DataFrame, stashed: DataFrame, by: str) -> DataFrame:
    """Counters by group: objects and bytes in all, live and dead. Roots are reachable commits and stashes."""
    live = reachable.select(by, "object").unionByName(stashed.select(by, "object")).distinct().withColumn("__live", F.lit(True))
    marked = objects.join(live, [by, "object"], "left")
    is_dead = F.col("__live").isNull()
    return marked.groupBy(by).agg(
        F.count(F.lit(1)).alias("objects"),
        F.count_if(~is_dead).alias("live_objects"),
        F.count_if(is_dead).alias("dead_objects"),
        F.coalesce(F.sum(F.when(is_dead, F.col("size"))), F.lit(0)).alias("dead_bytes"),
        F.sum("size").alias("all_bytes"),
    )
