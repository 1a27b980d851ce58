"""Histories: folds, versions, sizes, chains of commits, merge bases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import labels
from palimpsest.operators import reports, trees
from palimpsest.plans import views


def tree_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.fold(views.commit_files(spark, sf_dir)).select("branch", "path", "seq", "content", "size")


TREE_FOLD = f"""WITH {views.COMMIT_FILES}
SELECT branch, path, seq, content, size FROM (
  SELECT *, row_number() OVER (PARTITION BY branch, path ORDER BY seq DESC) AS rn FROM commit_files)
WHERE rn = 1 AND status <> 'D'"""


def version_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = trees.version_numbers(views.commit_files(spark, sf_dir))
    return found.select("branch", "seq", F.col("version").cast("bigint").alias("version"), F.concat(F.lit("Version "), F.col("version").cast("string")).alias("label"))


VERSION_NUMBER = f"""WITH {views.COMMIT_FILES}
SELECT branch, seq, rn AS version, 'Version ' || rn AS label
FROM (SELECT *, row_number() OVER (PARTITION BY branch ORDER BY seq) AS rn FROM commit_files)"""


def list_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits reachable from a tip that stands at the last commit that removed nothing; numbered among these."""
    log = views.commit_files(spark, sf_dir)
    tips = log.where("status <> 'D'").groupBy("branch").agg(F.max("seq").alias("tip"))
    reachable = log.join(tips, "branch").where("seq <= tip")
    return trees.version_numbers(reachable).select("branch", "seq", "path", "status", F.col("version").cast("bigint").alias("version"))


LIST_COMMITS = f"""WITH {views.COMMIT_FILES},
tips AS (SELECT branch, max(seq) AS tip FROM commit_files WHERE status <> 'D' GROUP BY branch)
SELECT branch, seq, path, status, row_number() OVER (PARTITION BY branch ORDER BY seq) AS version
FROM commit_files JOIN tips USING (branch) WHERE seq <= tip"""


def last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.newest(views.commit_files(spark, sf_dir), 5).select("branch", "seq", "path", F.col("nth").cast("bigint").alias("nth"))


LAST_N = f"""WITH {views.COMMIT_FILES}
SELECT branch, seq, path, nth FROM (SELECT *, row_number() OVER (PARTITION BY branch ORDER BY seq DESC) AS nth FROM commit_files) WHERE nth <= 5"""


def version_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.version_sizes(views.commit_files(spark, sf_dir))


_SIZES = """steps AS (
  SELECT branch, seq,
         CASE WHEN status = 'D' THEN 0 ELSE size END - coalesce(lag(CASE WHEN status = 'D' THEN 0 ELSE size END) OVER p, 0) AS db,
         CASE WHEN status = 'D' THEN 0 ELSE 1 END - coalesce(lag(CASE WHEN status = 'D' THEN 0 ELSE 1 END) OVER p, 0) AS df
  FROM commit_files WINDOW p AS (PARTITION BY branch, path ORDER BY seq)),
sizes AS (SELECT branch, seq, (sum(db) OVER b)::BIGINT AS tree_bytes, (sum(df) OVER b)::BIGINT AS tree_files
  FROM steps WINDOW b AS (PARTITION BY branch ORDER BY seq))"""
VERSION_SIZES = f"WITH {views.COMMIT_FILES}, {_SIZES} SELECT * FROM sizes"


def storage_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = views.commit_files(spark, sf_dir)
    found = trees.savings(trees.version_sizes(log), log)
    return found.withColumn("percent", labels.saved_percent(F.col("actual_bytes"), F.col("naive_bytes")))


STORAGE_SAVINGS = f"""WITH {views.COMMIT_FILES}, {_SIZES},
naive AS (SELECT branch, sum(tree_bytes)::BIGINT AS naive_bytes FROM sizes GROUP BY branch),
actual AS (SELECT branch, sum(size)::BIGINT AS actual_bytes FROM
  (SELECT branch, content, max(size) AS size FROM commit_files WHERE status <> 'D' GROUP BY ALL) GROUP BY branch),
both_ AS (SELECT branch, naive_bytes, coalesce(actual_bytes, 0) AS actual_bytes,
  greatest(0, naive_bytes - coalesce(actual_bytes, 0)) AS saved_bytes FROM naive LEFT JOIN actual USING (branch)),
near AS (SELECT *, floor(saved_bytes * 100.0::DOUBLE / naive_bytes + 0.5)::INTEGER AS p FROM both_)
SELECT branch, naive_bytes, actual_bytes, saved_bytes, CASE WHEN naive_bytes <= 0 THEN 0
  WHEN actual_bytes > 0 AND p > 99 THEN 99 WHEN saved_bytes > 0 AND p < 1 THEN 1 ELSE p END AS percent FROM near"""


def _lineages(spark: SparkSession, sf_dir: str) -> DataFrame:
    tips = views.tips(spark, sf_dir).select(F.col("id").alias("start"), F.col("branch").alias("segment"), F.col("id").alias("upto"))
    return trees.lineages(views.forks(spark, sf_dir), tips)


def reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and sums of what each tip reaches: running ones along every branch, looked up where a lineage leaves it."""
    log = views.commit_files(spark, sf_dir)
    so_far = Window.partitionBy("branch").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    totals = [F.count(F.lit(1)).over(so_far).alias("commits"), F.min("seq").over(so_far).alias("root"), F.sum("seq").over(so_far).alias("check_sum")]
    running = log.select(F.col("branch").alias("segment"), F.col("seq").alias("upto"), *totals)
    found = _lineages(spark, sf_dir).join(running, ["segment", "upto"])
    return found.groupBy("start").agg(F.sum("commits").alias("commits"), F.min("root").alias("root"), F.sum("check_sum").alias("check_sum"))


_CLOSURE = f"""WITH RECURSIVE {views.PARENTS},
up AS (SELECT id AS start, id AS ancestor FROM tips
  UNION ALL SELECT u.start, p.parent FROM up u JOIN parents p ON p.id = u.ancestor WHERE p.parent IS NOT NULL)"""
REACHABLE = f"{_CLOSURE} SELECT start, count(*) AS commits, min(ancestor) AS root, sum(ancestor)::BIGINT AS check_sum FROM up GROUP BY start"


def first_parent_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first-parent lines of every 30th branch's tip, by pointers that double."""
    parents = views.parents(spark, sf_dir).select("id", "parent")
    starts = views.tips(spark, sf_dir).where("branch % 30 = 0").select("id")
    depth = parents.count()  # no line is longer than the log
    return trees.chains(parents, starts, min(depth, 1 << 16))


FIRST_PARENT_CHAINS = f"""WITH RECURSIVE {views.PARENTS},
up AS (SELECT id AS start, id AS ancestor FROM tips WHERE branch % 30 = 0
  UNION ALL SELECT u.start, p.parent FROM up u JOIN parents p ON p.id = u.ancestor WHERE p.parent IS NOT NULL)
SELECT start, ancestor FROM up"""


def merge_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each branch's tip against the tip of the next branch."""
    tips = views.tips(spark, sf_dir)
    pairs = tips.select("branch", F.col("id").alias("left")).join(tips.select((F.col("branch") - 1).alias("branch"), F.col("id").alias("right")), "branch")
    found = trees.merge_bases(pairs.select("left", "right"), _lineages(spark, sf_dir))
    return found.withColumn("base", F.coalesce("base", F.lit(-1).cast("bigint")))


MERGE_BASE = f"""{_CLOSURE},
pairs AS (SELECT a.id AS left_id, b.id AS right_id FROM tips a JOIN tips b ON b.branch = a.branch + 1),
common AS (SELECT p.left_id, p.right_id, max(l.ancestor) AS base FROM pairs p JOIN up l ON l.start = p.left_id
  JOIN up r ON r.start = p.right_id AND r.ancestor = l.ancestor GROUP BY ALL)
SELECT p.left_id AS "left", p.right_id AS "right", coalesce(c.base, -1) AS base, coalesce(c.base = p.left_id, false) AS fast_forward
FROM pairs p LEFT JOIN common c ON c.left_id = p.left_id AND c.right_id = p.right_id"""


def undo_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tips that may be undone: no commit has them as parent."""
    parents = views.parents(spark, sf_dir)
    tips = views.tips(spark, sf_dir)
    used = parents.where("parent is not null").select(F.col("parent").alias("id")).distinct().withColumn("used", F.lit(True))
    return tips.join(used, "id", "left").select("branch", "id", F.col("used").isNull().alias("may_undo"))


UNDO_GUARD = f"""WITH {views.PARENTS}
SELECT branch, id, NOT EXISTS (SELECT 1 FROM parents p WHERE p.parent = tips.id) AS may_undo FROM tips"""


def commit_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = views.commit_files(spark, sf_dir)
    content = F.when(F.col("status") != "D", F.col("content"))
    return log.select("seq", labels.content_id([F.col("seq"), F.col("path"), content]).alias("id"))


COMMIT_IDS = f"""WITH {views.COMMIT_FILES}
SELECT seq, substr(sha256(concat_ws(chr(10), seq::VARCHAR, path, CASE WHEN status <> 'D' THEN content ELSE '-' END)), 1, 12) AS id FROM commit_files"""


def revert_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 9th commit of a branch restores the one four before it; rows count newest first."""
    log = trees.version_numbers(views.commit_files(spark, sf_dir))
    own = Window.partitionBy("branch").orderBy("seq")
    down = F.row_number().over(Window.partitionBy("branch").orderBy(F.desc("seq"))).cast("bigint")
    commits = log.select(F.col("seq").alias("id"), down.alias("row"), F.when(F.col("version") % 9 == 0, F.lag("seq", 4).over(own)).alias("restored_from"))
    return reports.revert_links(commits)


REVERT_LINKS = f"""WITH {views.COMMIT_FILES},
numbered AS (SELECT seq AS id, row_number() OVER (PARTITION BY branch ORDER BY seq) AS v,
  row_number() OVER (PARTITION BY branch ORDER BY seq DESC) AS "row", lag(seq, 4) OVER (PARTITION BY branch ORDER BY seq) AS back FROM commit_files),
commits AS (SELECT id, "row", CASE WHEN v % 9 = 0 THEN back END AS restored_from FROM numbered)
SELECT c.id AS "commit", c."row", t."row" AS target_row FROM commits c JOIN commits t ON t.id = c.restored_from"""


def tips_by_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branches of ten share the tip of the first of them."""
    tips = views.tips(spark, sf_dir)
    first = tips.groupBy(F.expr("branch div 10").alias("decade")).agg(F.min_by("id", "branch").alias("tip"))
    named = tips.select(F.expr("branch div 10").alias("decade"), F.concat(F.lit("b"), F.col("branch").cast("string")).alias("name"))
    return reports.tips_by_commit(named.join(first, "decade"))


TIPS_BY_COMMIT = f"""WITH {views.PARENTS},
first_ AS (SELECT branch // 10 AS decade, min_by(id, branch) AS tip FROM tips GROUP BY 1)
SELECT tip, string_agg('b' || branch, ', ' ORDER BY 'b' || branch) AS branches FROM tips JOIN first_ ON decade = branch // 10 GROUP BY tip"""


def branch_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = views.commit_files(spark, sf_dir).withColumn("repo", F.expr("branch div 10"))
    return reports.branch_colours(log, 7).withColumn("colour", F.col("colour").cast("bigint"))


BRANCH_COLOURS = f"""WITH {views.COMMIT_FILES},
first_ AS (SELECT branch // 10 AS repo, branch, min(seq) AS f FROM commit_files GROUP BY ALL)
SELECT repo, branch, (row_number() OVER (PARTITION BY repo ORDER BY CASE WHEN branch = 7 THEN 0 ELSE 1 END, f, branch) - 1) % 4 AS colour FROM first_"""


def commit_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lanes of histories of ten branches each; parents outside a history end a lane."""
    parents = views.parents(spark, sf_dir)
    rows = parents.select(F.expr("branch div 10").alias("repo"), F.col("id").alias("seq"), "id", F.array_compact(F.array("parent")).alias("parents"))
    return reports.lanes(rows)


QUERIES = {
    "tree_fold": (tree_fold, TREE_FOLD),
    "version_number": (version_number, VERSION_NUMBER),
    "list_commits": (list_commits, LIST_COMMITS),
    "last_n": (last_n, LAST_N),
    "version_sizes": (version_sizes, VERSION_SIZES),
    "storage_savings": (storage_savings, STORAGE_SAVINGS),
    "reachable": (reachable, REACHABLE),
    "first_parent_chains": (first_parent_chains, FIRST_PARENT_CHAINS),
    "merge_base": (merge_base, MERGE_BASE),
    "undo_guard": (undo_guard, UNDO_GUARD),
    "commit_ids": (commit_ids, COMMIT_IDS),
    "revert_links": (revert_links, REVERT_LINKS),
    "tips_by_commit": (tips_by_commit, TIPS_BY_COMMIT),
    "branch_colours": (branch_colours, BRANCH_COLOURS),
    "commit_lanes": (commit_lanes, None),
}
