"""Storage, garbage, timings, labels and pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import codecs, labels
from palimpsest.operators import raster, reports, store
from palimpsest.plans import views
from palimpsest.sources import palettes


def first_reference_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views.files(spark, sf_dir).withColumnRenamed("content", "object")
    sizes = f.groupBy("object").agg(F.max("size").alias("size"))
    return store.attributed_bytes(f.select("object", F.col("seq").alias("order"), "pack"), sizes, "pack")


FIRST_REFERENCE_BYTES = f"""WITH {views.FILES},
f AS (SELECT content, arg_min(pack, seq) AS pack, max(size) AS size FROM files GROUP BY content)
SELECT pack, sum(size)::BIGINT AS stored_bytes, count(*) AS objects FROM f GROUP BY pack"""


def _streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream for each branch and kind of path, with contents that come again."""
    log = views.commit_files(spark, sf_dir)
    kind = F.col("path").cast("int") % 4
    return log.select(F.concat(F.lit("entry:"), F.col("branch").cast("string"), F.lit(":"), kind.cast("string")).alias("stream"), "seq", (F.col("size") % 500).alias("content"), "size")


_STREAMS = f"""{views.COMMIT_FILES},
streams AS (SELECT 'entry:' || branch || ':' || (path::INTEGER % 4) AS stream, seq, size % 500 AS content, size FROM commit_files),
first_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stream, content ORDER BY seq) AS r FROM streams) WHERE r = 1)"""


def stream_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.distinct_versions(_streams(spark, sf_dir)).select("stream", "content", "seq", "size")


STREAM_VERSIONS = f"WITH {_STREAMS} SELECT stream, content, seq, size FROM first_"


def chain_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of at least 60 bytes may be patches; seven patches to a snapshot."""
    versions = store.distinct_versions(_streams(spark, sf_dir))
    return store.chain_lengths(versions, F.col("size") >= 60, most=7).select("stream", "seq", "chain_len")


CHAIN_LENGTH = f"""WITH {_STREAMS},
runs AS (SELECT *, sum(CASE WHEN size >= 60 THEN 0 ELSE 1 END) OVER (PARTITION BY stream ORDER BY seq) AS run FROM first_)
SELECT stream, seq, ((row_number() OVER (PARTITION BY stream, run ORDER BY seq) - 1) % 8)::INTEGER AS chain_len FROM runs"""


def dead_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects that only branches that are gone (every 5th) and no stash refer to."""
    objects, reachable, stashed = _roots(spark, sf_dir)
    return store.dead(objects, reachable.unionByName(stashed)).select("object", "size")


def _roots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    log = views.commit_files(spark, sf_dir).select(F.expr("branch div 10").alias("repo"), "branch", "seq", (F.col("size") % 3000).alias("object"), "size", "status")
    objects = log.where("status <> 'D'").groupBy("object").agg(F.max("size").alias("size"))
    return objects, log.where("branch % 5 <> 0").select("object").distinct(), log.where("branch % 5 = 0 and seq % 50 = 0").select("object").distinct()


_ROOTS = f"""{views.COMMIT_FILES},
log AS (SELECT branch // 10 AS repo, branch, seq, size % 3000 AS object, size, status FROM commit_files)"""
DEAD_OBJECTS = f"""WITH {_ROOTS}
SELECT object, max(size) AS size FROM log WHERE status <> 'D' AND object NOT IN (SELECT object FROM log WHERE branch % 5 <> 0 OR seq % 50 = 0) GROUP BY object"""


def gc_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Garbage counters of each repository of ten branches, with whether its pack is worth rewriting."""
    log = views.commit_files(spark, sf_dir).select(F.expr("branch div 10").alias("repo"), "branch", "seq", (F.col("size") % 3000).alias("object"), "size")
    objects = log.groupBy("repo", "object").agg(F.max("size").alias("size"))
    found = reports.garbage(objects, log.where("branch % 5 <> 0"), log.where("branch % 5 = 0 and seq % 50 = 0"), "repo")
    return found.withColumn("rewrite", store.worth_rewriting(F.col("dead_bytes"), F.col("all_bytes")))


GC_REPORT = f"""WITH {_ROOTS},
o AS (SELECT repo, object, max(size) AS size, bool_or(branch % 5 <> 0 OR seq % 50 = 0) AS live FROM log GROUP BY ALL)
SELECT repo, count(*) AS objects, count(*) FILTER (live) AS live_objects, count(*) FILTER (NOT live) AS dead_objects,
  coalesce(sum(size) FILTER (NOT live), 0)::BIGINT AS dead_bytes, sum(size)::BIGINT AS all_bytes,
  coalesce(sum(size) FILTER (NOT live), 0) > 0 AND coalesce(sum(size) FILTER (NOT live), 0) * 4 > sum(size) AS rewrite FROM o GROUP BY repo"""


def lru_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache files of each pack to delete for a budget of 60,000 bytes a pack."""
    return store.prune(views.files(spark, sf_dir), F.lit(60_000), "pack", ["seq"]).select("pack", "path", "size")


LRU_PRUNE = f"""WITH {views.FILES},
m AS (SELECT *, sum(size) OVER (PARTITION BY pack) AS total, coalesce(sum(size) OVER (PARTITION BY pack ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM files)
SELECT pack, path, size FROM m WHERE total - gone > 60000"""


def pack_consolidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small packs (documents by source and language) of each language with enough of them."""
    d = views.table(spark, sf_dir, "documents")
    packs = d.groupBy("lang", "source").agg(F.sum("n_chars").alias("bytes"))
    return store.consolidated(packs, 20_000, 3, "lang")


PACK_CONSOLIDATE = """WITH p AS (SELECT lang, source, sum(n_chars)::BIGINT AS bytes FROM documents GROUP BY ALL),
s AS (SELECT *, count(*) OVER (PARTITION BY lang) AS n FROM p WHERE bytes <= 20000)
SELECT lang, source, bytes FROM s WHERE n >= 3"""


def retention_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of each pack whose bytes a scan keeps: 40,000, greedy in scan order."""
    return store.retained(views.files(spark, sf_dir), "pack", "seq", "size", 40_000).select("pack", "seq", "size", "kept")


RETENTION_BUDGET = f"""WITH RECURSIVE {views.FILES},
f AS (SELECT pack, seq, size, row_number() OVER (PARTITION BY pack ORDER BY seq) AS nth FROM files),
g AS (SELECT pack, seq, size, nth, CASE WHEN size <= 40000 THEN size ELSE 0 END AS used, size <= 40000 AS kept FROM f WHERE nth = 1
  UNION ALL SELECT f.pack, f.seq, f.size, f.nth, g.used + CASE WHEN g.used + f.size <= 40000 THEN f.size ELSE 0 END, g.used + f.size <= 40000
  FROM g JOIN f ON f.pack = g.pack AND f.nth = g.nth + 1)
SELECT pack, seq, size, kept FROM g"""


def timing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reports.timing_summary(views.samples(spark, sf_dir))
    return found.withColumn("mean_ms", F.round("mean_ms", 6))


TIMING_SUMMARY = f"WITH {views.SAMPLES} SELECT op, count(*) AS samples, round(avg(ms), 6) AS mean_ms FROM samples GROUP BY op"


def timing_by_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reports.timing_by_commit(views.samples(spark, sf_dir))
    return found.select("commit_id", F.coalesce("save_ms", F.lit(-1)).alias("save_ms"), F.coalesce("compare_ms", F.lit(-1)).alias("compare_ms"))


_BY_COMMIT = f"""{views.SAMPLES},
by_commit AS (SELECT commit_id, coalesce(arg_max(ms, ts) FILTER (op = 'commit'), arg_min(ms, ts) FILTER (op IN ('merge', 'rollback'))) AS save_ms,
  arg_max(ms, ts) FILTER (op = 'diff') AS compare_ms FROM samples WHERE commit_id IS NOT NULL GROUP BY commit_id)"""
TIMING_BY_COMMIT = f"""WITH {_BY_COMMIT} SELECT commit_id, coalesce(save_ms, -1) AS save_ms, coalesce(compare_ms, -1) AS compare_ms
FROM by_commit WHERE save_ms IS NOT NULL OR compare_ms IS NOT NULL"""


def version_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A card for each branch tip: version count, bytes, and timings where there are any."""
    log = views.commit_files(spark, sf_dir)
    cards = log.groupBy("branch").agg(F.count(F.lit(1)).alias("versions"), F.sum("size").alias("bytes"))
    times = timing_by_commit(spark, sf_dir).withColumnRenamed("commit_id", "branch")
    found = cards.join(times, "branch", "left")
    return found.select("branch", "versions", "bytes", F.coalesce("save_ms", F.lit(-1)).alias("save_ms"), labels.byte_unit(F.col("bytes")).alias("unit"), labels.byte_tenths(F.col("bytes")).alias("tenths"))


_SCALE = "CASE WHEN bytes < 1024 THEN 1 WHEN bytes < 1048576 THEN 1024 WHEN bytes < 1073741824 THEN 1048576 WHEN bytes < 1099511627776 THEN 1073741824 ELSE 1099511627776 END"
VERSION_CARDS = f"""WITH {views.COMMIT_FILES}, {_BY_COMMIT},
c AS (SELECT branch, count(*) AS versions, sum(size)::BIGINT AS bytes FROM commit_files GROUP BY branch)
SELECT branch, versions, bytes, coalesce(save_ms, -1) AS save_ms,
  CASE WHEN bytes < 1024 THEN 'B' WHEN bytes < 1048576 THEN 'KB' WHEN bytes < 1073741824 THEN 'MB' WHEN bytes < 1099511627776 THEN 'GB' ELSE 'TB' END AS unit,
  floor(bytes * 10.0::DOUBLE / {_SCALE} + 0.5)::BIGINT AS tenths
FROM c LEFT JOIN by_commit b ON b.commit_id = c.branch"""


def latest_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 100 timing samples of each operation, and the five newest named."""
    nth = F.row_number().over(Window.partitionBy("op").orderBy(F.desc("ts")))
    ranked = views.samples(spark, sf_dir).withColumn("nth", nth).where("nth <= 100")
    return ranked.select("op", "ts", "ms", F.col("nth").cast("bigint").alias("nth"), (F.col("nth") <= 5).alias("shown"))


LATEST_SAMPLES = f"""WITH {views.SAMPLES}
SELECT op, ts, ms, nth, nth <= 5 AS shown FROM (SELECT *, row_number() OVER (PARTITION BY op ORDER BY ts DESC) AS nth FROM samples) WHERE nth <= 100"""


def opacity_and_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = views.table(spark, sf_dir, "lineitem")
    opacity = (F.col("l_orderkey") % 256).cast("int")
    mode = F.element_at(F.array(*[F.lit(x) for x in ("svg:multiply", "screen", "linear_dodge", "darken", "svg:overlay", "add")]), (F.col("l_partkey") % 6 + 1).cast("int"))
    return li.select("l_orderkey", labels.opacity_percent(opacity).alias("percent"), labels.blend_mode(mode).alias("blend")).distinct()


OPACITY_AND_BLEND = """SELECT DISTINCT l_orderkey, round((l_orderkey % 256) * 100.0::DOUBLE / 255.0)::INTEGER AS percent,
  ['multiply', 'screen', 'add', 'normal', 'overlay', 'add'][(l_partkey % 6 + 1)::BIGINT] AS blend FROM lineitem"""


def colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours of parts: hexadecimal, and from CMYK in whole per cents."""
    p = views.table(spark, sf_dir, "part")
    c, m, y, k = ((F.col("p_partkey") * n % 101) / 100.0 for n in (7, 11, 13, 17))
    r, g, b = labels.cmyk_to_rgb(c, m, y, k)
    return p.select("p_partkey", labels.hex_colour(r, g, b).alias("colour"), labels.hex_colour(*[F.col("p_partkey") * n % 256 for n in (3, 5, 7)]).alias("plain"))


def _unit(n: int) -> str:
    return f"round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (1 - (p_partkey * {n} % 101)::DOUBLE / 100.0) * (1 - (p_partkey * 17 % 101)::DOUBLE / 100.0))) * 255)::INTEGER"


COLOURS = f"""SELECT p_partkey, '#' || {" || ".join(f"printf('%02X', {_unit(n)})" for n in (7, 11, 13))} AS colour,
  '#' || {" || ".join(f"printf('%02X', (p_partkey * {n} % 256)::INTEGER)" for n in (3, 5, 7))} AS plain FROM part"""


def times(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "events")
    epoch = F.unix_timestamp("ts")
    return e.select("event_id", labels.iso_time(epoch).alias("iso"), labels.age(F.col("event_id") * 7 % 90_000).alias("age"))


TIMES = """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso,
  CASE WHEN event_id * 7 % 90000 < 60 THEN (event_id * 7 % 90000) || 's' WHEN event_id * 7 % 90000 < 3600 THEN (event_id * 7 % 90000 // 60) || 'm'
       ELSE (event_id * 7 % 90000 // 3600) || 'h' END AS age FROM events"""


def path_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths made of page addresses under the rules for safety, kinds, names and shards."""
    p = views.table(spark, sf_dir, "pages")
    tail = F.regexp_replace("url", "^https?://", "")
    ext = F.element_at(F.array(*[F.lit(x) for x in (".kra", ".GPL", ".txt", "-autosave.kra", "/../x.kpl")]), (F.col("page_id") % 5 + 1).cast("int"))
    path = F.concat(F.when(F.col("page_id") % 7 == 0, "/").otherwise(""), tail, ext)
    entry = F.lit("a:entry:b")
    keys = [labels.file_key(F.concat(tail, F.lit(":tile:1"))), labels.tile_key(tail, entry, F.col("page_id"), F.lit(-64)), labels.entry_key(tail, F.lit("a")), labels.manifest_key(tail), tail]
    key = F.element_at(F.array(*keys), (F.col("page_id") % 5 + 1).cast("int"))
    return p.select(
        "page_id",
        labels.supported(path).alias("supported"),
        labels.safe_path(path).alias("safe"),
        labels.branch_name_valid(F.substring_index(tail, "/", 1)).alias("name_valid"),
        labels.branch_name_valid(tail).alias("path_as_name"),
        labels.shard_of(key).alias("shard"),
        labels.palette_key(path).alias("palette_key"),
    )


PATH_RULES = r"""WITH t AS (SELECT page_id, regexp_replace(url, '^https?://', '') AS tail FROM pages),
p AS (SELECT *, CASE WHEN page_id % 7 = 0 THEN '/' ELSE '' END || tail || ['.kra', '.GPL', '.txt', '-autosave.kra', '/../x.kpl'][(page_id % 5 + 1)::BIGINT] AS path,
  CASE WHEN page_id % 5 = 0 THEN tail || ':tile:1' ELSE tail END AS shard FROM t)
SELECT page_id, regexp_matches(lower(path), '\.(kra|gpl|kpl|aco|ase)$') AND NOT lower(path) LIKE '%-autosave.kra' AS supported,
  path <> '' AND NOT starts_with(path, '/') AND NOT starts_with(path, './') AND path <> '.' AND NOT list_contains(string_split(path, '/'), '..') AS safe,
  strlen(trim(string_split(tail, '/')[1])) BETWEEN 1 AND 60 AND NOT regexp_matches(trim(string_split(tail, '/')[1]), '[\x00-\x1F\x7F/\\:*?"<>|]') AS name_valid,
  strlen(trim(tail)) BETWEEN 1 AND 60 AND NOT regexp_matches(trim(tail), '[\x00-\x1F\x7F/\\:*?"<>|]') AS path_as_name,
  shard, regexp_replace(regexp_replace(lower(string_split(path, '/')[-1]), '\.(kpl|gpl|aco|ase)$', ''), '\.[0-9]+$', '') AS palette_key FROM p"""


#: Fixed value: what the labels of asset paths are tried on.
_ENDINGS = (".kra", ".GPL", ".jpeg", ".0012.kpl", "", "::palettes/sun-set_two.0006.kpl")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What parts are called as layers, files and palettes, by names with hyphens, underscores and runs of spaces."""
    p = views.table(spark, sf_dir, "part")
    pick = lambda values, n: F.element_at(F.array(*[F.lit(x) for x in values]), (F.col("p_partkey") % n + 1).cast("int"))
    slug = F.concat(F.lit(" "), F.replace("p_name", F.lit(" "), pick(("-", "__", "  "), 3)), F.lit("- "))
    path = F.concat(F.lit("art/"), F.replace("p_name", F.lit(" "), F.lit("_")), pick(_ENDINGS, len(_ENDINGS)))
    return p.select(
        "p_partkey",
        labels.title_case(slug).alias("title"),
        labels.status_verb(pick("AMDRCUZ", 7)).alias("verb"),
        labels.layer_id(F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(""), F.col("p_name")).alias("layer"),
        labels.layer_type(pick(("paintlayer", "vectorlayer", "filtermask", "", "colorizelayer"), 5)).alias("layer_type"),
        labels.layer_change(pick(("added", "unchanged", "other"), 3)).alias("change"),
        labels.asset_name(path).alias("asset"),
        labels.asset_kind(path).alias("kind"),
        labels.palette_name(path).alias("palette"),
        labels.embedded_palette(path).alias("embedded"),
        labels.version_label(F.col("p_size")).alias("version"),
    )


LABELLED = rf"""WITH n AS (SELECT *, list_filter(string_split(p_name, ' '), lambda w: w <> '') AS words, replace(p_name, ' ', '_') AS slug,
  {list(_ENDINGS)}[(p_partkey % 6 + 1)::BIGINT] AS ending FROM part)
SELECT p_partkey, list_reduce(list_transform(words, lambda w: upper(w[1]) || w[2:]), lambda a, b: a || ' ' || b) AS title,
  ['Added', 'Updated', 'Deleted', 'Renamed', 'Needs review', 'New', 'Z'][(p_partkey % 7 + 1)::BIGINT] AS verb,
  CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_name END AS layer,
  ['Paint', 'Vector', 'Mask', 'Layer', 'Colorize'][(p_partkey % 5 + 1)::BIGINT] AS layer_type,
  ['Added', 'Unchanged', 'other'][(p_partkey % 3 + 1)::BIGINT] AS change,
  CASE p_partkey % 6 WHEN 3 THEN p_name || '.0012' WHEN 5 THEN 'sun set two.0006' ELSE p_name END AS asset,
  ['Artwork', 'Palette', 'Reference', 'Settings', 'Settings', 'Settings'][(p_partkey % 6 + 1)::BIGINT] AS kind,
  CASE p_partkey % 6 WHEN 5 THEN 'sun set two' ELSE p_name END AS palette,
  p_partkey % 6 IN (1, 3, 5) AS embedded, 'Version ' || p_size AS version FROM n"""


def moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times against the newest of all events, durations and sizes as they are shown."""
    e = views.table(spark, sf_dir, "events")
    now = e.agg(F.max("ts").alias("now"))  # one row
    ms, size = F.col("event_id") * 37 % 5000, F.col("event_id") * F.col("event_id") * 12345 % 2_000_000_000_000
    joined = e.join(F.broadcast(now))
    return joined.select(
        "event_id",
        labels.relative_time(F.col("ts"), F.col("now")).alias("ago"),
        labels.full_timestamp(F.col("ts")).alias("moment"),
        labels.ms_text(ms).alias("took"),
        labels.byte_text(size).alias("size"),
        labels.operation_label(F.col("event_type")).alias("operation"),
        labels.operation_label(F.element_at(F.array(*map(F.lit, ("commit", "create", "fetch"))), (F.col("event_id") % 3 + 1).cast("int")), plain=True).alias("plain"),
    )


MOMENTS = """WITH m AS (SELECT *, floor((epoch_ms(now) - epoch_ms(ts)) / 60000.0::DOUBLE + 0.5)::BIGINT AS mi FROM (SELECT *, max(ts) OVER () AS now FROM events)),
h AS (SELECT *, floor(mi / 60.0::DOUBLE + 0.5)::BIGINT AS hr FROM m), d AS (SELECT *, floor(hr / 24.0::DOUBLE + 0.5)::BIGINT AS dy, event_id * 37 % 5000 AS ms, event_id * event_id * 12345 % 2000000000000 AS sz FROM h),
u AS (SELECT *, CASE WHEN sz < 1024 ** 2 THEN 1 WHEN sz < 1024 ** 3 THEN 2 WHEN sz < 1024 ** 4 THEN 3 ELSE 4 END AS k FROM d),
t AS (SELECT *, floor(sz * 10.0::DOUBLE / 1024 ** k + 0.5)::BIGINT AS tenths, floor(ms / 100.0::DOUBLE + 0.5)::BIGINT AS ds FROM u)
SELECT event_id, CASE WHEN mi < 1 THEN 'just now' WHEN mi < 60 THEN mi || 'm ago' WHEN hr < 24 THEN hr || 'h ago' WHEN dy < 7 THEN dy || 'd ago' ELSE strftime(ts, '%b %-d') END AS ago,
  strftime(ts, '%b %-d, %Y · %H:%M') AS moment, CASE WHEN ms < 1000 THEN ms || 'ms' ELSE ds // 10 || '.' || ds % 10 || 's' END AS took,
  CASE WHEN sz < 1024 THEN sz || ' B' ELSE tenths // 10 || '.' || tenths % 10 || ' ' || ['KB', 'MB', 'GB', 'TB'][k] END AS size,
  upper(event_type[1]) || event_type[2:] AS operation, ['Save', 'New line', 'fetch'][(event_id % 3 + 1)::BIGINT] AS plain FROM t"""


def stash_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shelved sets of files (orders of a customer) by label or files, and their one-line summaries."""
    o = views.table(spark, sf_dir, "orders")
    path = F.concat(F.lit("art/order-"), F.col("o_orderkey").cast("string"), F.lit(".kra"))
    held = o.where("o_orderkey % 2 = 0").groupBy(F.col("o_custkey").alias("stash")).agg(F.array_sort(F.collect_list(path)).alias("paths"), F.max("o_orderdate").alias("made"))
    every = views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("stash"), F.when(F.col("c_custkey") % 4 == 0, F.col("c_name")).otherwise(" ").alias("label"))
    both = every.join(held, "stash", "left")
    paths = F.coalesce("paths", F.array().cast("array<string>"))
    now = F.lit("2030-01-01").cast("timestamp")
    made = F.coalesce("made", F.expr("timestamp'2029-12-31 22:10:00'"))
    return both.select("stash", labels.stash_title(F.col("label"), paths).alias("title"), labels.stash_summary(F.size(paths), F.lit("main"), made, now).alias("summary"))


STASH_TITLES = """WITH h AS (SELECT o_custkey, list_sort(list('order ' || o_orderkey)) AS names, max(o_orderdate) AS made FROM
  (SELECT * FROM orders WHERE o_orderkey % 2 = 0) GROUP BY 1),
b AS (SELECT c_custkey AS stash, c_name, coalesce(names, []) AS names, made FROM customer LEFT JOIN h ON o_custkey = c_custkey)
SELECT stash, CASE WHEN stash % 4 = 0 THEN c_name WHEN len(names) = 0 THEN 'Empty' WHEN len(names) = 1 THEN names[1]
    ELSE names[1] || ', ' || names[2] || CASE WHEN len(names) > 2 THEN ' +' || (len(names) - 2) ELSE '' END END AS title,
  len(names) || CASE WHEN len(names) = 1 THEN ' file' ELSE ' files' END || ' · on main · ' || CASE WHEN made IS NULL THEN '2h ago' ELSE strftime(made, '%b %-d') END AS summary FROM b"""


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each image against the one after it."""
    return raster.change_grid(views.pixels(spark, sf_dir), views.pixels(spark, sf_dir, 1), ["v"])


_GRID = f"""{views.PIXELS},
grid AS (SELECT a.image, a.x, a.y, abs(a.v - b.v) > 16 AS changed FROM px a JOIN px b ON b.image = a.image + 1 AND b.x = a.x AND b.y = a.y)"""


def pixel_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.box(_grid(spark, sf_dir))


PIXEL_BOX = f"WITH {_GRID} SELECT image, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1, count(*) AS pixels FROM grid WHERE changed GROUP BY image"


def coarse_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.coarse(_grid(spark, sf_dir), 4)


COARSE_GRID = f"WITH {_GRID} SELECT image, (x // 4)::BIGINT AS bx, (y // 4)::BIGINT AS \"by\", bool_or(changed) AS changed FROM grid GROUP BY ALL"


def downscaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = views.pixels(spark, sf_dir)
    full = px.select("image", "x", "y", *[F.abs((F.col("v") * n) % 256).alias(c) for c, n in (("r", 3), ("g", 5), ("b", 7), ("a", 11))])
    return raster.downscale(full, 4)


DOWNSCALED = f"""WITH {views.PIXELS},
f AS (SELECT image, x, y, abs(v * 3 % 256) AS r, abs(v * 5 % 256) AS g, abs(v * 7 % 256) AS b, abs(v * 11 % 256) AS a FROM px)
SELECT image, (x // 4)::BIGINT AS x, (y // 4)::BIGINT AS y,
  {", ".join(f"(CASE WHEN sum(a) = 0 THEN 0 ELSE (2 * sum({c} * a) + sum(a)) // (2 * sum(a)) END)::BIGINT AS {c}" for c in "rgb")},
  ((2 * sum(a) + count(*)) // (2 * count(*)))::BIGINT AS a, count(*) AS area FROM f GROUP BY image, x // 4, y // 4"""


def composite_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.table(spark, sf_dir, "part")
    return raster.blocks(p.select(F.col("p_partkey").alias("image"), (F.col("p_size") * 37).alias("width"), (F.col("p_partkey") % 900).cast("int").alias("height")), 256)


COMPOSITE_BLOCKS = """WITH c AS (SELECT p_partkey AS image, p_size * 37 AS width, (p_partkey % 900)::INTEGER AS height FROM part),
x AS (SELECT *, unnest(range(0, (width - 1) // 256 + 1)) AS bx FROM c WHERE width > 0 AND height > 0),
xy AS (SELECT *, unnest(range(0, (height - 1) // 256 + 1)) AS "by" FROM x)
SELECT image, bx, "by", least(256, width - bx * 256) AS w, least(256, height - "by" * 256) AS h FROM xy"""


def outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.outlines(_grid(spark, sf_dir))


def gpl_swatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text palettes of parts by brand, written and parsed back natively."""
    p = views.table(spark, sf_dir, "part")
    line = F.concat_ws(" ", (F.col("p_size") * 9 - 40).cast("string"), F.col("p_size").cast("string"), (F.col("p_partkey") % 256).cast("string"), "p_name")
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("line")))), lambda x: x["line"]), "\r\n")
    text = p.groupBy(F.col("p_brand").alias("file")).agg(F.concat(F.lit("GIMP Palette\nColumns: 3\n# all\n"), lines).alias("text"))
    return palettes.gpl(text).select("file", "pos", "name", "r", "g", "b")


GPL_SWATCHES = """SELECT p_brand AS file, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS pos, p_name AS name,
  least(255, greatest(0, p_size * 9 - 40))::INTEGER AS r, least(255, greatest(0, p_size))::INTEGER AS g, (p_partkey % 256)::INTEGER AS b FROM part"""


def tile_codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles packed and unpacked again: sizes, and whether nothing was lost."""
    px = views.pixels(spark, sf_dir)
    packed = px.groupBy("image").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "v"))), lambda p: F.lpad(F.hex(F.abs(p["v"]) % 16), 2, "0")), "").alias("digits"))
    data = packed.select("image", F.unhex("digits").alias("data"))
    small = data.withColumn("packed", codecs.lzf_compress("data"))
    back = small.withColumn("back", codecs.lzf_decompress("packed", F.octet_length("data")))
    return back.select("image", F.octet_length("data").alias("n_bytes"), F.octet_length("packed").alias("packed_bytes"), F.col("back").eqNullSafe(F.col("data")).alias("same"))


QUERIES = {
    "first_reference_bytes": (first_reference_bytes, FIRST_REFERENCE_BYTES),
    "stream_versions": (stream_versions, STREAM_VERSIONS),
    "chain_length": (chain_length, CHAIN_LENGTH),
    "dead_objects": (dead_objects, DEAD_OBJECTS),
    "gc_report": (gc_report, GC_REPORT),
    "lru_prune": (lru_prune, LRU_PRUNE),
    "pack_consolidate": (pack_consolidate, PACK_CONSOLIDATE),
    "retention_budget": (retention_budget, RETENTION_BUDGET),
    "timing_summary": (timing_summary, TIMING_SUMMARY),
    "timing_by_commit": (timing_by_commit, TIMING_BY_COMMIT),
    "version_cards": (version_cards, VERSION_CARDS),
    "latest_samples": (latest_samples, LATEST_SAMPLES),
    "opacity_and_blend": (opacity_and_blend, OPACITY_AND_BLEND),
    "colours": (colours, COLOURS),
    "times": (times, TIMES),
    "path_rules": (path_rules, PATH_RULES),
    "labelled": (labelled, LABELLED),
    "moments": (moments, MOMENTS),
    "stash_titles": (stash_titles, STASH_TITLES),
    "pixel_box": (pixel_box, PIXEL_BOX),
    "coarse_grid": (coarse_grid, COARSE_GRID),
    "downscaled": (downscaled, DOWNSCALED),
    "composite_blocks": (composite_blocks, COMPOSITE_BLOCKS),
    "outlines": (outlines, None),
    "gpl_swatches": (gpl_swatches, GPL_SWATCHES),
    "tile_codecs": (tile_codecs, None),
}
