"""The provided tables seen as a version store, each view beside the same view as SQL text.

Every view is a projection or one window over a table, so filters and column
pruning reach the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def commit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One changed path for each commit; a branch is one linear history."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("seq"),
        F.col("user_id").alias("branch"),
        F.get_json_object("props", "$.k").alias("path"),
        F.when(F.col("event_type") == "error", "D").otherwise("M").alias("status"),
        F.md5(F.concat(F.col("event_id").cast("string"), F.col("event_type"))).alias("content"),
        F.round(F.col("value") * 100).cast("bigint").alias("size"),
    )


COMMIT_FILES = """commit_files AS (
  SELECT event_id AS seq, user_id AS branch, json_extract_string(props, '$.k') AS path,
         CASE WHEN event_type = 'error' THEN 'D' ELSE 'M' END AS status,
         md5(concat(event_id::VARCHAR, event_type)) AS content,
         round(value * 100)::BIGINT AS size
  FROM events)"""


def parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, branch, parent): a branch follows its own last commit; its first one forks off the last commit before it of branch div 2."""
    log = commit_files(spark, sf_dir).select("seq", "branch")
    own = F.lag("seq").over(Window.partitionBy("branch").orderBy("seq"))
    linked = log.select(F.col("seq").alias("id"), "branch", own.alias("own"))
    first = linked.where("own is null and branch > 0").select("id", F.expr("branch div 2").alias("from"))
    fork = first.join(log.select("seq", F.col("branch").alias("from")), "from").where("seq < id").groupBy("id").agg(F.max("seq").alias("fork"))
    return linked.join(fork, "id", "left").select("id", "branch", F.coalesce("own", "fork").alias("parent"))


def forks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(segment, parent_segment, fork): where each branch forks off another."""
    found = parents(spark, sf_dir).groupBy("branch").agg(F.min_by("parent", "id").alias("fork"))
    return found.where("fork is not null").select(F.col("branch").alias("segment"), F.expr("branch div 2").alias("parent_segment"), "fork")


PARENTS = f"""{COMMIT_FILES},
linked AS (SELECT seq AS id, branch, lag(seq) OVER (PARTITION BY branch ORDER BY seq) AS own FROM commit_files),
fork AS (SELECT l.id, max(c.seq) AS fork FROM linked l JOIN commit_files c ON c.branch = l.branch // 2 AND c.seq < l.id
         WHERE l.own IS NULL AND l.branch > 0 GROUP BY l.id),
parents AS (SELECT l.id, l.branch, coalesce(l.own, f.fork) AS parent FROM linked l LEFT JOIN fork f USING (id)),
tips AS (SELECT branch, max(seq) AS id FROM commit_files GROUP BY branch)"""


def tips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commit_files(spark, sf_dir).groupBy("branch").agg(F.max("seq").alias("id"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracked files: one object a document, in groups by source."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("seq"), F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("content"), F.col("n_chars").alias("size"), F.col("source").alias("pack"))


FILES = """files AS (
  SELECT doc_id AS seq, doc_id::VARCHAR AS path, sha256(text) AS content, n_chars AS size, source AS pack FROM documents)"""


def tree(spark: SparkSession, sf_dir: str, drop: int, edit: int | None = None) -> DataFrame:
    """A tree of orders without every `drop`-th path; every `edit`-th content is changed by `drop`."""
    o = table(spark, sf_dir, "orders")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    content = F.when(F.col("o_orderkey") % edit == 0, cents + drop).otherwise(cents) if edit else cents
    return o.where(F.col("o_orderkey") % drop != 0).select(F.col("o_orderkey").alias("path"), content.cast("string").alias("content"))


def tree_sql(name: str, drop: int, edit: int | None = None) -> str:
    cents = "round(o_totalprice * 100)::BIGINT"
    content = f"CASE WHEN o_orderkey % {edit} = 0 THEN {cents} + {drop} ELSE {cents} END" if edit else cents
    return f"{name} AS (SELECT o_orderkey AS path, ({content})::VARCHAR AS content FROM orders WHERE o_orderkey % {drop} <> 0)"


BASE, CURRENT, SOURCE = (10, None), (7, 3), (11, 4)
TREES = ", ".join((tree_sql("base", *BASE), tree_sql("cur", *CURRENT), tree_sql("src", *SOURCE)))


def tiles(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """Tiles (entry, x, y, hash) of the old or the new side; of rows with the same key the first stays."""
    li = table(spark, sf_dir, "lineitem")
    tag = F.concat_ws("-", F.col("l_quantity").cast("bigint").cast("string"), F.col("l_linenumber").cast("string"))
    if side == "new":
        li = li.where("l_suppkey % 10 <> 0")
        tag = F.when(F.col("l_orderkey") % 5 == 0, F.concat(tag, F.lit("e"))).otherwise(tag)
    else:
        li = li.where("l_partkey % 7 <> 0")
    keyed = li.select(F.col("l_suppkey").alias("entry"), F.col("l_orderkey").alias("x"), F.col("l_partkey").alias("y"), F.md5(tag).alias("hash"))
    return keyed.groupBy("entry", "x", "y").agg(F.min("hash").alias("hash"))


def _tiles_sql(name: str, where: str, tag: str) -> str:
    return f"""{name} AS (SELECT l_suppkey AS entry, l_orderkey AS x, l_partkey AS y, min(md5({tag})) AS hash
  FROM lineitem WHERE {where} GROUP BY ALL)"""


_TAG = "concat_ws('-', l_quantity::BIGINT::VARCHAR, l_linenumber::VARCHAR)"
TILES = ", ".join(
    (
        _tiles_sql("tiles_old", "l_partkey % 7 <> 0", _TAG),
        _tiles_sql("tiles_new", "l_suppkey % 10 <> 0", f"CASE WHEN l_orderkey % 5 = 0 THEN {_TAG} || 'e' ELSE {_TAG} END"),
    )
)


def swatches(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """Swatches (file, pos, name, colour) of the old or the new side of palettes by brand."""
    p = table(spark, sf_dir, "part")
    p = p.where("p_partkey % 3 <> 0") if side == "old" else p.where("p_partkey % 5 <> 0")
    colour = F.col("p_size").cast("bigint")
    if side == "new":
        colour = F.when(F.col("p_partkey") % 4 == 0, colour + 1).otherwise(colour)
    return p.select(F.col("p_brand").alias("file"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("name"), colour.cast("string").alias("colour"))


SWATCHES = """old_s AS (SELECT p_brand AS file, p_partkey AS pos, p_name AS name, p_size::VARCHAR AS colour FROM part WHERE p_partkey % 3 <> 0),
new_s AS (SELECT p_brand AS file, p_partkey AS pos, p_name AS name,
          (p_size::BIGINT + CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 0 END)::VARCHAR AS colour FROM part WHERE p_partkey % 5 <> 0)"""


def pixels(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    """An 8 by 8 image of one channel for each vector; `shift` names it after an earlier one."""
    e = table(spark, sf_dir, "embeddings")
    cells = e.select((F.col("vec_id") - shift).alias("image"), F.posexplode("embedding").alias("p", "v"))
    value = F.round(F.col("v").cast("double") * 255).cast("bigint")
    return cells.select("image", (F.col("p") % 8).alias("x"), F.expr("p div 8").cast("int").alias("y"), value.alias("v"))


PIXELS = """cells AS (SELECT vec_id, unnest(embedding) AS v, unnest(range(0, len(embedding))) AS p FROM embeddings),
px AS (SELECT vec_id AS image, (p % 8)::INTEGER AS x, (p // 8)::INTEGER AS y, round(v::DOUBLE * 255)::BIGINT AS v FROM cells)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timing samples: an operation, whole milliseconds, and a commit for most."""
    e = table(spark, sf_dir, "events")
    op = F.element_at(F.array(*[F.lit(x) for x in OPS]), (F.col("event_id") % len(OPS) + 1).cast("int"))
    commit = F.when(F.col("event_id") % 11 != 0, F.col("user_id"))
    return e.select(op.alias("op"), F.round(F.col("value") * 10).cast("bigint").alias("ms"), F.col("event_id").alias("ts"), commit.alias("commit_id"))


OPS = ("commit", "diff", "merge", "rollback", "scan")
SAMPLES = f"""samples AS (SELECT [{", ".join(f"'{x}'" for x in OPS)}][(event_id % {len(OPS)} + 1)::BIGINT] AS op,
  round(value * 10)::BIGINT AS ms, event_id AS ts, CASE WHEN event_id % 11 <> 0 THEN user_id END AS commit_id FROM events)"""
