"""Differences and merges: scans, trees, tiles, layers, palettes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import labels
from palimpsest.operators import diff, merge_layers
from palimpsest.plans import views


def scan_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A working tree without every 5th file, every 4th edited, against an index without every 7th."""
    f = views.files(spark, sf_dir)
    edited = F.when(F.col("seq") % 4 == 0, F.concat("content", F.lit("x"))).otherwise(F.col("content"))
    return diff.scan_status(f.where("seq % 5 <> 0").withColumn("content", edited), f.where("seq % 7 <> 0"))


SCAN_STATUS = f"""WITH {views.FILES},
now AS (SELECT path, CASE WHEN seq % 4 = 0 THEN content || 'x' ELSE content END AS content FROM files WHERE seq % 5 <> 0),
idx AS (SELECT path, content FROM files WHERE seq % 7 <> 0)
SELECT path, status FROM (
  SELECT coalesce(n.path, i.path) AS path, CASE WHEN i.path IS NULL THEN 'U' WHEN n.path IS NULL THEN 'D' WHEN n.content <> i.content THEN 'M' END AS status
  FROM now n FULL JOIN idx i ON n.path = i.path) WHERE status IS NOT NULL"""


def scan_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which files a scan must read: sizes and times against the index, whose own time is 500."""
    f = views.files(spark, sf_dir).select("seq", "path", "size", (F.col("seq") % 1000).alias("mtime"))
    old_size = F.when(F.col("seq") % 3 == 0, F.col("size") + 1).otherwise(F.col("size"))
    old_mtime = F.when(F.col("seq") % 5 == 0, F.lit(0)).otherwise(F.col("mtime"))
    return f.select("path", diff.needs_hash(F.col("size"), F.col("mtime"), old_size, old_mtime, F.lit(500)).alias("reads"))


SCAN_READS = f"""WITH {views.FILES},
s AS (SELECT path, size, seq % 1000 AS mtime, CASE WHEN seq % 3 = 0 THEN size + 1 ELSE size END AS os, CASE WHEN seq % 5 = 0 THEN 0 ELSE seq % 1000 END AS om FROM files)
SELECT path, NOT (size = os AND mtime = om AND NOT (size = 0 AND mtime = 0) AND mtime < 500) AS reads FROM s"""


def _trees(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(views.tree(spark, sf_dir, *side) for side in (views.BASE, views.CURRENT, views.SOURCE))


def rollback_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, current, _ = _trees(spark, sf_dir)
    return diff.tree_changes(current, base)


ROLLBACK_DIFF = f"""WITH {views.TREES}
SELECT path, status, content FROM (
  SELECT coalesce(b.path, c.path) AS path, b.content AS content,
    CASE WHEN c.path IS NULL THEN 'A' WHEN b.path IS NULL THEN 'D' WHEN b.content IS DISTINCT FROM c.content THEN 'M' END AS status
  FROM cur c FULL JOIN base b ON b.path = c.path) WHERE status IS NOT NULL"""


def materialize_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File actions that turn the current tree into the source tree."""
    _, current, source = _trees(spark, sf_dir)
    found = diff.tree_changes(current, source)
    return found.select("path", F.when(F.col("status") == "D", "delete").otherwise("write").alias("action"), "content")


MATERIALIZE_PLAN = f"""WITH {views.TREES}
SELECT path, action, content FROM (
  SELECT coalesce(s.path, c.path) AS path, s.content AS content,
    CASE WHEN s.path IS NULL THEN 'delete' WHEN s.content IS DISTINCT FROM c.content THEN 'write' END AS action
  FROM cur c FULL JOIN src s ON s.path = c.path) WHERE action IS NOT NULL"""


def discard_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discarding working changes (source over base) of even paths: new files go, others are written back."""
    base, _, source = _trees(spark, sf_dir)
    found = diff.scan_status(source, base).where("path % 2 = 0").join(base, "path", "left")
    return found.select("path", F.when(F.col("status") == "U", "delete").otherwise("write").alias("action"), "content")


DISCARD_ACTIONS = f"""WITH {views.TREES},
st AS (SELECT coalesce(s.path, b.path) AS path, b.content, CASE WHEN b.path IS NULL THEN 'delete' WHEN s.path IS NULL OR s.content <> b.content THEN 'write' END AS action
  FROM src s FULL JOIN base b ON s.path = b.path)
SELECT path, action, content FROM st WHERE action IS NOT NULL AND path % 2 = 0"""


def undo_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of an undone commit (every 13th of the current tree) against the new tip's tree: restored or removed from the index."""
    base, current, _ = _trees(spark, sf_dir)
    popped = current.where("path % 13 = 0").select("path")
    known = base.withColumnRenamed("content", "restored")
    return popped.join(known, "path", "left").select("path", F.when(F.col("restored").isNull(), "remove").otherwise("restore").alias("action"), "restored")


UNDO_RESTORE = f"""WITH {views.TREES}
SELECT c.path, CASE WHEN b.content IS NULL THEN 'remove' ELSE 'restore' END AS action, b.content AS restored
FROM cur c LEFT JOIN base b ON b.path = c.path WHERE c.path % 13 = 0"""


def stash_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stashed paths that are dirty, whatever their bytes; stashes by the path's last digit, sorted and joined."""
    base, current, source = _trees(spark, sf_dir)
    dirty = diff.scan_status(current, base).select("path")
    stashed = source.where("path % 17 = 0").select((F.col("path") % 10).alias("stash"), "path")
    hit = stashed.join(dirty, "path", "left_semi").groupBy("stash")
    return hit.agg(F.count(F.lit(1)).alias("conflicts"), F.array_join(F.array_sort(F.collect_list(F.col("path").cast("string"))), ", ").alias("paths"))


STASH_CONFLICT = f"""WITH {views.TREES},
dirty AS (SELECT coalesce(c.path, b.path) AS path FROM cur c FULL JOIN base b ON b.path = c.path WHERE c.path IS NULL OR b.path IS NULL OR c.content <> b.content)
SELECT path % 10 AS stash, count(*) AS conflicts, string_agg(path::VARCHAR, ', ' ORDER BY path::VARCHAR) AS paths
FROM src WHERE path % 17 = 0 AND path IN (SELECT path FROM dirty) GROUP BY 1"""


def three_way_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.three_way(*_trees(spark, sf_dir))


THREE_WAY_MERGE = f"""WITH {views.TREES},
k AS (SELECT path FROM base UNION SELECT path FROM cur UNION SELECT path FROM src),
j AS (SELECT k.path, b.content AS b, c.content AS c, s.content AS s FROM k LEFT JOIN base b USING (path) LEFT JOIN cur c USING (path) LEFT JOIN src s USING (path))
SELECT path, status, CASE WHEN s IS NOT NULL THEN s WHEN status = 'C' THEN c END AS content FROM (
  SELECT *, CASE WHEN s IS NOT NULL THEN CASE WHEN c IS DISTINCT FROM b THEN 'C' WHEN c IS NOT NULL THEN 'M' ELSE 'A' END
    WHEN c IS NOT NULL THEN CASE WHEN c IS DISTINCT FROM b THEN 'C' ELSE 'D' END END AS status
  FROM j WHERE s IS DISTINCT FROM c AND s IS DISTINCT FROM b) WHERE status IS NOT NULL"""


def tile_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.changed_entries(views.tiles(spark, sf_dir, "old"), views.tiles(spark, sf_dir, "new"), 64)


_TILE_DIFF = f"""WITH {views.TILES},
j AS (SELECT n.entry, n.x, n.y, n.hash IS DISTINCT FROM o.hash AS d FROM tiles_new n LEFT JOIN tiles_old o ON o.entry = n.entry AND o.x = n.x AND o.y = n.y),
a AS (SELECT entry, count(*) AS new_tiles, count(*) FILTER (d) AS changed_tiles, min(x) FILTER (d) AS x0, min(y) FILTER (d) AS y0,
  max(x) FILTER (d) + 64 AS x1, max(y) FILTER (d) + 64 AS y1 FROM j GROUP BY entry),
found AS (SELECT a.* FROM a LEFT JOIN (SELECT entry, count(*) AS n FROM tiles_old GROUP BY entry) o USING (entry) WHERE changed_tiles > 0 OR new_tiles <> coalesce(n, 0))"""
TILE_DIFF = f"{_TILE_DIFF} SELECT * FROM found"


def changed_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tile_diff(spark, sf_dir).where("x0 is not null")
    return found.select("entry", *[F.round(c, 9).alias(n) for c, n in zip(diff.region(65536, 4096), ("x", "y", "w", "h"), strict=True)])


CHANGED_REGION = f"""{_TILE_DIFF}
SELECT entry, round(greatest(0, x0 / 65536), 9) AS x, round(greatest(0, y0 / 4096), 9) AS y,
  round(greatest(0, least(1, (x1 - x0) / 65536)), 9) AS w, round(greatest(0, least(1, (y1 - y0) / 4096)), 9) AS h FROM found WHERE x0 IS NOT NULL"""


def layer_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.bounds(views.tiles(spark, sf_dir, "new"), 64)


LAYER_BOUNDS = f"WITH {views.TILES} SELECT entry, min(x) AS x0, min(y) AS y0, max(x) + 64 AS x1, max(y) + 64 AS y1 FROM tiles_new GROUP BY entry"


def palette_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = diff.keyed_list_diff(views.swatches(spark, sf_dir, "old"), views.swatches(spark, sf_dir, "new"), ["file", "name"], "colour", "pos")
    return found.withColumn("nth", F.col("nth").cast("bigint"))


_PALETTE_DIFF = f"""WITH {views.SWATCHES},
o AS (SELECT *, row_number() OVER (PARTITION BY file, name ORDER BY pos) AS nth FROM old_s),
n AS (SELECT *, row_number() OVER (PARTITION BY file, name ORDER BY pos) AS nth FROM new_s),
d AS (SELECT coalesce(n.file, o.file) AS file, coalesce(n.name, o.name) AS name, coalesce(n.nth, o.nth) AS nth, o.colour AS before, n.colour AS after,
  CASE WHEN o.pos IS NULL THEN 'added' WHEN n.pos IS NULL THEN 'removed' WHEN o.colour = n.colour THEN 'unchanged' ELSE 'modified' END AS change,
  coalesce(n.pos, o.pos) AS pos FROM o FULL JOIN n ON o.file = n.file AND o.name = n.name AND o.nth = n.nth)"""
PALETTE_DIFF = f"{_PALETTE_DIFF} SELECT * FROM d"


def embedded_palette_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Palettes that changed, with the number of each kind of change; unchanged ones are left out."""
    count = lambda kind: F.count_if(F.col("change") == kind).alias(kind)
    found = palette_diff(spark, sf_dir).groupBy("file").agg(count("added"), count("removed"), count("modified"))
    return found.where("added + removed + modified > 0")


EMBEDDED_PALETTE_DIFF = f"""{_PALETTE_DIFF}
SELECT file, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'removed') AS removed, count(*) FILTER (change = 'modified') AS modified
FROM d GROUP BY file HAVING count(*) FILTER (change <> 'unchanged') > 0"""


def logical_palettes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The representative of each logical palette: a .kpl before others, then the greatest name."""
    p = views.table(spark, sf_dir, "part")
    ext = F.when(F.col("p_partkey") % 3 == 0, ".kpl").when(F.col("p_partkey") % 3 == 1, ".gpl").otherwise(".0001.kpl")
    ext = F.when(F.col("p_partkey") % 7 == 0, ".12.aco").when(F.col("p_partkey") % 11 == 0, ".v2.png").otherwise(ext)
    name = F.concat(F.lit("palettes/"), F.regexp_replace("p_name", " ", "_"), ext)
    named = p.select(name.alias("name")).distinct().withColumn("key", labels.palette_key(F.col("name")))
    return named.groupBy("key").agg(F.max_by("name", F.struct(F.lower("name").endswith(".kpl"), "name")).alias("representative"), F.count(F.lit(1)).alias("copies"))


LOGICAL_PALETTES = r"""WITH named AS (SELECT DISTINCT 'palettes/' || replace(p_name, ' ', '_') ||
  CASE WHEN p_partkey % 7 = 0 THEN '.12.aco' WHEN p_partkey % 11 = 0 THEN '.v2.png' WHEN p_partkey % 3 = 0 THEN '.kpl' WHEN p_partkey % 3 = 1 THEN '.gpl' ELSE '.0001.kpl' END AS name FROM part),
keyed AS (SELECT name, regexp_replace(regexp_replace(lower(string_split(name, '/')[-1]), '\.(kpl|gpl|aco|ase)$', ''), '\.[0-9]+$', '') AS key FROM named)
SELECT key, max_by(name, (lower(name) LIKE '%.kpl', name)) AS representative, count(*) AS copies FROM keyed GROUP BY key"""


def _layers(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """Layers of documents by nation: suppliers over customers of the same number."""
    t = views.table(spark, sf_dir, "customer" if side == "old" else "supplier")
    p = "c" if side == "old" else "s"
    key = F.col(f"{p}_{'cust' if p == 'c' else 'supp'}key")
    return t.select(
        key.alias("pos"),
        F.when(key % 6 != 0, F.concat(F.lit("u"), (key % 400).cast("string"))).otherwise("").alias("uuid"),
        F.concat(F.lit("layer "), F.col(f"{p}_nationkey").cast("string")).alias("name"),
        (F.floor(F.col(f"{p}_acctbal")).cast("bigint") % 256).alias("opacity"),
        F.when(key % 4 == 0, "multiply").otherwise("normal").alias("blend"),
    )


def layer_meta_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = diff.layer_changes(_layers(spark, sf_dir, "old"), _layers(spark, sf_dir, "new"))
    return found.select(F.col("place.side").cast("bigint").alias("side"), F.col("place.pos").alias("pos"), "id", "name", "change", F.array_join("details", "; ").alias("details"))


_LAYERS = """SELECT *, coalesce(nullif(uuid, ''), name) AS id FROM (SELECT {k} AS pos, CASE WHEN {k} % 6 <> 0 THEN 'u' || ({k} % 400) ELSE '' END AS uuid, 'layer ' || {p}_nationkey AS name,
  floor({p}_acctbal)::BIGINT % 256 AS opacity, CASE WHEN {k} % 4 = 0 THEN 'multiply' ELSE 'normal' END AS blend FROM {t})"""
LAYER_META_DIFF = f"""WITH olds AS ({_LAYERS.format(k="c_custkey", p="c", t="customer")}), news AS ({_LAYERS.format(k="s_suppkey", p="s", t="supplier")}),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS r FROM olds) WHERE r = 1),
d AS (SELECT n.pos, n.id, n.name, o.id AS oid, concat_ws('; ', CASE WHEN o.opacity <> n.opacity THEN 'opacity ' || o.opacity || ' -> ' || n.opacity END,
    CASE WHEN o.blend <> n.blend THEN 'blend ' || o.blend || ' -> ' || n.blend END, CASE WHEN o.name <> n.name THEN 'renamed ' || o.name || ' -> ' || n.name END) AS details
  FROM news n LEFT JOIN o ON o.id = n.id)
SELECT 0::BIGINT AS side, pos, id, name, CASE WHEN oid IS NULL THEN 'added' ELSE 'modified' END AS change, CASE WHEN oid IS NULL THEN '' ELSE details END AS details
FROM d WHERE oid IS NULL OR details <> ''
UNION ALL SELECT 1, pos, id, name, 'removed', '' FROM olds WHERE id NOT IN (SELECT id FROM news)"""


def art_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers of the new side with their painted box and change, then removed ones."""
    old, new = views.tiles(spark, sf_dir, "old"), views.tiles(spark, sf_dir, "new")
    changed = diff.changed_entries(old, new, 64).select("entry", "changed_tiles")
    known = old.select("entry").distinct().withColumn("__old", F.lit(True))
    status = F.when(F.col("__old").isNull(), "added").when(F.col("changed_tiles").isNotNull(), "modified").otherwise("unchanged")
    there = diff.bounds(new, 64).join(known, "entry", "left").join(changed, "entry", "left").select("entry", status.alias("change"), F.coalesce("changed_tiles", F.lit(0)).alias("changed_tiles"), "x0", "y0", "x1", "y1")
    gone = diff.bounds(old, 64).join(new.select("entry").distinct(), "entry", "left_anti")
    return there.unionByName(gone.select("entry", F.lit("removed").alias("change"), F.lit(0).cast("bigint").alias("changed_tiles"), "x0", "y0", "x1", "y1"))


ART_DIFF = f"""{_TILE_DIFF},
bn AS (SELECT entry, min(x) AS x0, min(y) AS y0, max(x) + 64 AS x1, max(y) + 64 AS y1 FROM tiles_new GROUP BY entry),
bo AS (SELECT entry, min(x) AS x0, min(y) AS y0, max(x) + 64 AS x1, max(y) + 64 AS y1 FROM tiles_old GROUP BY entry)
SELECT bn.entry, CASE WHEN bo.entry IS NULL THEN 'added' WHEN f.entry IS NOT NULL THEN 'modified' ELSE 'unchanged' END AS change,
  coalesce(f.changed_tiles, 0) AS changed_tiles, bn.x0, bn.y0, bn.x1, bn.y1 FROM bn LEFT JOIN bo USING (entry) LEFT JOIN found f ON f.entry = bn.entry
UNION ALL SELECT entry, 'removed', 0, x0, y0, x1, y1 FROM bo WHERE entry NOT IN (SELECT entry FROM bn)"""


def _layer_tiles(spark: SparkSession, sf_dir: str, edited: bool) -> DataFrame:
    li = views.table(spark, sf_dir, "lineitem")
    tile = F.col("l_quantity").cast("bigint")
    if edited:
        tile = F.when((F.col("l_orderkey") % 50 == 0) & (F.col("l_linenumber") == 1), tile + 100).otherwise(tile)
    return li.select(F.col("l_orderkey").alias("uuid"), (F.col("l_orderkey") % 3).alias("signature"), tile.alias("tile"))


def unchanged_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.unchanged_layers(_layer_tiles(spark, sf_dir, True), _layer_tiles(spark, sf_dir, False))


_LAYER_TILES = "SELECT l_orderkey AS uuid, l_orderkey % 3 AS signature, list_sort(list({t})) AS tiles FROM lineitem GROUP BY 1, 2"
UNCHANGED_LAYERS = f"""WITH a AS ({_LAYER_TILES.format(t="l_quantity::BIGINT")}),
i AS ({_LAYER_TILES.format(t="l_quantity::BIGINT + CASE WHEN l_orderkey % 50 = 0 AND l_linenumber = 1 THEN 100 ELSE 0 END")})
SELECT i.uuid, i.signature, len(i.tiles) AS tiles FROM i JOIN a ON a.uuid = i.uuid AND a.signature = i.signature AND a.tiles = i.tiles"""


def _incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers of documents by nation, with names that come again."""
    s = views.table(spark, sf_dir, "supplier")
    return s.select(F.col("s_nationkey").cast("long").alias("document"), F.col("s_suppkey").alias("pos"), F.concat(F.lit("layer "), (F.col("s_suppkey") % 3).cast("string")).alias("name"))


def layer_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that incoming layers take in a document where customers have taken some."""
    c = views.table(spark, sf_dir, "customer")
    taken = c.where("c_custkey % 5 = 0").select(F.col("c_nationkey").cast("long").alias("document"), F.concat(F.lit("layer "), (F.col("c_custkey") % 2).cast("string"), F.when(F.col("c_custkey") % 10 == 0, " [3]").otherwise("")).alias("name"))
    return merge_layers.renamed(_incoming(spark, sf_dir), taken.distinct())


def layer_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that incoming layers take above the numbers of the document's own."""
    c = views.table(spark, sf_dir, "customer")
    taken = c.select(F.col("c_nationkey").cast("long").alias("document"), F.concat(F.when(F.col("c_custkey") % 4 == 0, "shape").otherwise("layer"), F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 9 == 0, "a").otherwise("")).alias("file"))
    return merge_layers.renumbered(_incoming(spark, sf_dir), taken).select("document", "pos", "new_file")


LAYER_FILES = """WITH h AS (SELECT c_nationkey AS document, max(c_custkey) AS highest FROM customer WHERE c_custkey % 4 <> 0 AND c_custkey % 9 <> 0 GROUP BY 1)
SELECT s_nationkey::BIGINT AS document, s_suppkey AS pos, 'layer' || (coalesce(highest, 0) + row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey)) AS new_file
FROM supplier LEFT JOIN h ON h.document = s_nationkey"""


def layer_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures, attribute tokens, new opening tags and ids of layers made of parts."""
    p = views.table(spark, sf_dir, "part")
    name = F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, F.lit(' <"a"&b>')).otherwise(""))
    attributes = {"name": name, "opacity": F.col("p_size"), "compositeop": F.when(F.col("p_size") % 2 == 0, "multiply"), "visible": F.lit(None), "x": F.col("p_partkey") % 7, "y": F.lit(0)}
    token = labels.xml_attribute("name", labels.xml_escape(name))
    tag = F.when(F.col("p_partkey") % 4 == 0, "<layer opacity=").otherwise(F.concat(F.lit("<layer filename="), F.lit('"n" '), token, F.lit(' uuid="name"/>')))
    return p.select(
        "p_partkey",
        F.replace(labels.layer_signature(attributes), F.lit("\0"), F.lit("|")).alias("signature"),
        token.alias("token"),
        labels.with_name(tag, labels.xml_escape(F.lit("x & y"))).alias("tag"),
        labels.fresh_uuid(F.col("p_brand"), F.col("p_partkey")).alias("uuid"),
    )


LAYER_TOKENS = """WITH n AS (SELECT *, p_name || CASE WHEN p_partkey % 3 = 0 THEN ' <"a"&b>' ELSE '' END AS name FROM part),
d AS (SELECT *, replace(replace(replace(replace(name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped,
  sha256('merge' || chr(0) || p_brand || chr(0) || p_partkey) AS h FROM n)
SELECT p_partkey, 'name=' || name || '|opacity=' || p_size || '|compositeop=' || CASE WHEN p_size % 2 = 0 THEN 'multiply' ELSE '' END || '|visible=|x=' || (p_partkey % 7) || '|y=0' AS signature,
  'name="' || escaped || '"' AS token, CASE WHEN p_partkey % 4 <> 0 THEN '<layer filename="n" name="x &amp; y" uuid="name"/>' END AS tag,
  '{' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] || '}' AS uuid FROM d"""


QUERIES = {
    "scan_status": (scan_status, SCAN_STATUS),
    "scan_reads": (scan_reads, SCAN_READS),
    "rollback_diff": (rollback_diff, ROLLBACK_DIFF),
    "materialize_plan": (materialize_plan, MATERIALIZE_PLAN),
    "discard_actions": (discard_actions, DISCARD_ACTIONS),
    "undo_restore": (undo_restore, UNDO_RESTORE),
    "stash_conflict": (stash_conflict, STASH_CONFLICT),
    "three_way_merge": (three_way_merge, THREE_WAY_MERGE),
    "tile_diff": (tile_diff, TILE_DIFF),
    "changed_region": (changed_region, CHANGED_REGION),
    "layer_bounds": (layer_bounds, LAYER_BOUNDS),
    "palette_diff": (palette_diff, PALETTE_DIFF),
    "embedded_palette_diff": (embedded_palette_diff, EMBEDDED_PALETTE_DIFF),
    "logical_palettes": (logical_palettes, LOGICAL_PALETTES),
    "layer_meta_diff": (layer_meta_diff, LAYER_META_DIFF),
    "art_diff": (art_diff, ART_DIFF),
    "unchanged_layers": (unchanged_layers, UNCHANGED_LAYERS),
    "layer_names": (layer_names, None),
    "layer_files": (layer_files, LAYER_FILES),
    "layer_tokens": (layer_tokens, LAYER_TOKENS),
}
