"""Documents and their store: reuse of entries, stream references, rebuild plans, patches, packs, keys and sniffs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import labels
from palimpsest.operators import documents, raster, versions
from palimpsest.plans import views


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as entries of documents by brand; every fifth size is empty."""
    p = views.table(spark, sf_dir, "part")
    path = F.concat_ws("/", F.lit("img"), "p_name", F.col("p_partkey").cast("string"))
    return p.select(
        F.col("p_brand").alias("file"),
        F.col("p_partkey").cast("int").alias("entry_pos"),
        path.alias("entry_path"),
        (F.col("p_partkey") * 7919 % 100_003).alias("crc32"),
        F.when(F.col("p_size") % 5 == 0, 0).otherwise(F.col("p_size")).cast("long").alias("size"),
        F.encode("p_name", "UTF-8").alias("content"),
    )


def entry_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries against a manifest without every 9th and with another checksum for every 4th of them."""
    entries = _entries(spark, sf_dir)
    crc = F.when(F.col("entry_pos") % 4 == 0, F.col("crc32") + 1).otherwise(F.col("crc32"))
    before = entries.where("entry_pos % 9 <> 0").select("file", "entry_path", crc.alias("crc32"), "size", F.concat(F.lit("old"), F.col("entry_pos").cast("string")).alias("blob"))
    return documents.manifest(entries, before).select("file", "entry_path", "blob", "reused")


_ENTRIES = """entries AS (SELECT p_brand AS file, p_partkey::INTEGER AS entry_pos, 'img/' || p_name || '/' || p_partkey AS entry_path,
  CASE WHEN p_size % 5 = 0 THEN 0 ELSE p_size END AS size, p_name FROM part)"""
ENTRY_REUSE = f"""WITH {_ENTRIES}, r AS (SELECT *, size > 0 AND entry_pos % 9 <> 0 AND entry_pos % 4 <> 0 AS reused FROM entries)
SELECT file, entry_path, CASE WHEN reused THEN 'old' || entry_pos ELSE sha256(p_name) END AS blob, reused FROM r"""


def _refs(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    t = views.tiles(spark, sf_dir, side)
    return t.select(F.concat(F.lit("doc"), (F.col("entry") % 7).cast("string")).alias("file"), F.concat(F.lit("layer"), F.col("entry").cast("string")).alias("entry_path"), "x", "y", "hash")


def _manifest(refs: DataFrame, modulus: int) -> DataFrame:
    """A tiled entry for each, whose blob says little, and one plain entry beside it."""
    number = F.regexp_extract("entry_path", "[0-9]+", 0).cast("int")
    tiled = refs.select("file", "entry_path").distinct().select("file", number.alias("entry_pos"), "entry_path", F.concat(F.lit("b"), (number % modulus).cast("string")).alias("blob"))
    return tiled.unionByName(tiled.select("file", (-F.col("entry_pos")).alias("entry_pos"), F.concat("entry_path", F.lit(".icc")).alias("entry_path"), "blob"))


def rebuild_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What turns the old documents' archives into the new ones."""
    old, new = _refs(spark, sf_dir, "old"), _refs(spark, sf_dir, "new")
    return documents.rebuild_plan(_manifest(new, 3), _manifest(old, 6), new, old)


_REFS = f"""{views.TILES},
refs_old AS (SELECT 'doc' || (entry % 7) AS file, 'layer' || entry AS entry_path, entry, x, y, hash FROM tiles_old),
refs_new AS (SELECT 'doc' || (entry % 7) AS file, 'layer' || entry AS entry_path, entry, x, y, hash FROM tiles_new),
plain AS (SELECT DISTINCT file, entry, entry_path FROM refs_new)"""
REBUILD_PLAN = f"""WITH {_REFS},
there AS (SELECT DISTINCT entry FROM refs_old),
m AS (SELECT file, entry::INTEGER AS entry_pos, entry_path, entry FROM plain UNION ALL SELECT file, -entry::INTEGER, entry_path || '.icc', entry FROM plain),
c AS (SELECT n.entry_path, count(*) AS tiles, count(o.entry) AS reused FROM refs_new n
  LEFT JOIN (SELECT DISTINCT entry, x, y, hash FROM refs_old) o ON o.entry = n.entry AND o.x = n.x AND o.y = n.y AND o.hash = n.hash GROUP BY 1)
SELECT file, entry_pos, m.entry_path, CASE WHEN t.entry IS NOT NULL AND m.entry % 3 = m.entry % 6 THEN 'copy' ELSE 'write' END AS action,
  coalesce(tiles, 0) AS tiles, coalesce(reused, 0) AS reused_tiles FROM m LEFT JOIN there t USING (entry) LEFT JOIN c ON c.entry_path = m.entry_path"""


def referenced_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = _refs(spark, sf_dir, "new")
    return documents.referenced_streams(_manifest(refs, 3), refs)


REFERENCED_STREAMS = f"""WITH {_REFS}
SELECT 'kra:' || file || ':entry:' || entry_path || '.icc' AS stream, 'b' || (entry % 3) AS content FROM plain
UNION ALL SELECT 'kra:' || file || ':tile:' || entry_path || ':' || x || ',' || y, hash FROM refs_new"""


def raster_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of layer pictures, composites and overlays."""
    refs = _refs(spark, sf_dir, "new").groupBy("entry_path").agg(F.collect_list(F.struct("x", "y", "hash")).alias("tiles"))
    fill = F.when(F.length("entry_path") % 2 == 0, F.lit(b"\x01\x02\x03\xff"))
    key = documents.layer_key(F.col("entry_path"), F.lit(128), F.lit(64), fill, F.col("tiles"))
    return refs.select("entry_path", key.alias("layer"), documents.composite_key(F.col("entry_path")).alias("composite"), documents.overlay_key(F.col("entry_path"), F.lit("x")).alias("overlay"))


RASTER_KEYS = f"""WITH {_REFS},
k AS (SELECT entry_path, string_agg(x || ',' || y || ',' || hash, chr(0) ORDER BY x, y, hash) AS t FROM refs_new GROUP BY 1)
SELECT entry_path, sha256(concat_ws(chr(0), 'layer', entry_path, '128x64', '2048', 'box1', CASE WHEN length(entry_path) % 2 = 0 THEN '010203ff' ELSE '00000000' END, t)) AS layer,
  sha256(concat_ws(chr(0), 'composite', entry_path, '2048', 'box1')) AS composite, sha256(concat_ws(chr(0), 'diffmask', entry_path, 'x', '2048', 'box1')) AS overlay FROM k"""


def patch_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of a branch as patches on the one before, every 8th a snapshot; every 50th is live."""
    log = views.commit_files(spark, sf_dir)
    versions = log.selectExpr("branch AS stream", "seq AS content", "lag(seq) OVER (PARTITION BY branch ORDER BY seq) AS before", "row_number() OVER (PARTITION BY branch ORDER BY seq) AS nth")
    versions = versions.select("stream", "content", F.when(F.col("nth") % 8 != 1, F.col("before")).alias("base"))
    return documents.closed_over_bases(log.where("seq % 50 = 0").selectExpr("branch AS stream", "seq AS content"), versions, 7)


PATCH_CLOSURE = f"""WITH RECURSIVE {views.COMMIT_FILES},
v AS (SELECT branch AS stream, seq AS content, CASE WHEN row_number() OVER w % 8 <> 1 THEN lag(seq) OVER w END AS base FROM commit_files WINDOW w AS (PARTITION BY branch ORDER BY seq)),
up AS (SELECT stream, content, base FROM v WHERE content % 50 = 0 UNION SELECT v.stream, v.content, v.base FROM up JOIN v ON v.stream = up.stream AND v.content = up.base)
SELECT stream, content FROM up"""


def pack_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document begins in the pack of its source, after a header of 12 bytes."""
    f = views.files(spark, sf_dir)
    return documents.pack_offsets(f, "pack", ["seq"], 12).select("pack", "path", F.col("offset").cast("long").alias("offset"))


PACK_OFFSETS = f"""WITH {views.FILES}
SELECT pack, path, (12 + coalesce(sum(size) OVER (PARTITION BY pack ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "offset" FROM files"""


def stale_temporary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leftovers of interrupted writes among paths made of orders, over an hour old."""
    o = views.table(spark, sf_dir, "orders")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("o_orderkey") % len(values) + 1).cast("int"))
    path = F.concat(pick(("store/", "store/chains/", "store/chains/deep/")), F.col("o_orderkey").cast("string"), pick((".tmp", ".json")))
    files = o.select(path.alias("path"), F.lit(1).cast("long").alias("size"), (F.col("o_custkey") * 60_000_000_000).alias("mtime_ns"))
    return documents.stale_temporary(files, ["store", "store/chains"], 7200 * 1_000_000_000)


STALE_TEMPORARY = """SELECT ['store/', 'store/chains/'][(o_orderkey % 3 + 1)::BIGINT] || o_orderkey || '.tmp' AS path, 1::BIGINT AS size, o_custkey * 60000000000 AS mtime_ns
FROM orders WHERE o_orderkey % 3 < 2 AND o_orderkey % 2 = 0 AND o_custkey < 60"""


def sampled_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of five by three pixels against ones of eight by eight."""
    before = views.pixels(spark, sf_dir)
    after = views.pixels(spark, sf_dir, 1).where("x < 5 and y < 3")
    sizes = after.select("image").distinct().select("image", *[F.lit(v).alias(n) for n, v in (("before_width", 8), ("before_height", 8), ("width", 5), ("height", 3))])
    return raster.sampled_change_grid(before, after, sizes, ["v"])


SAMPLED_GRID = f"""WITH {views.PIXELS}
SELECT a.image, a.x, a.y, abs(a.v - b.v) > 16 AS changed FROM (SELECT image - 1 AS image, x, y, v FROM px WHERE x < 5 AND y < 3) a
JOIN px b ON b.image = a.image AND b.x = a.x * 8 // 5 AND b.y = a.y * 8 // 3"""


def payload_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How documents begin, as payloads: whether they are packed already, and their first bytes as a default pixel."""
    d = views.table(spark, sf_dir, "documents")
    begin = F.element_at(F.array(*[F.lit(b) for b in (b"\x89PNG", b"PK\x03\x04", b"\x28\xb5\x2f\xfd", b"PK", b"\x01\x02\x03\x04")]), (F.col("doc_id") % 5 + 1).cast("int"))
    tail = F.when(F.col("doc_id") % 2 == 0, F.encode(F.coalesce("text", F.lit("")), "UTF-8")).otherwise(F.lit(b""))
    payload = F.concat(begin, tail)
    pixel = F.hex(labels.default_pixel(begin))
    eligible = (F.octet_length(payload) >= 64) & ~labels.compressed(payload)
    return d.select("doc_id", labels.compressed(payload).alias("compressed"), pixel.alias("pixel"), eligible.alias("patchable"), labels.object_name(F.sha2(payload, 256), F.when(F.col("doc_id") % 3 == 0, "b")).alias("object"))


PAYLOAD_RULES = r"""WITH p AS (SELECT doc_id, ['\x89PNG'::BLOB, 'PK\x03\x04'::BLOB, '\x28\xB5\x2F\xFD'::BLOB, 'PK'::BLOB, '\x01\x02\x03\x04'::BLOB][(doc_id % 5 + 1)::BIGINT] ||
  CASE WHEN doc_id % 2 = 0 THEN encode(coalesce(text, '')) ELSE ''::BLOB END AS payload FROM documents)
SELECT doc_id, doc_id % 5 < 3 AS compressed, ['4E508947', '034B5004', '2FB528FD', NULL, '03020104'][(doc_id % 5 + 1)::BIGINT] AS pixel,
  octet_length(payload) >= 64 AND doc_id % 5 >= 3 AS patchable, sha256(payload) || CASE WHEN doc_id % 3 = 0 THEN '.b.patch' ELSE '.full' END AS object FROM p"""


def patched_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as versions of streams by source, stored as snapshots and patches and replayed: chain lengths, and whether all came back."""
    d = views.table(spark, sf_dir, "documents")
    all_versions = d.select(F.col("source").alias("stream"), F.col("doc_id").alias("seq"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("payload"))
    back = versions.replayed(versions.stored(all_versions, least=600, most=5))
    return back.select("stream", "seq", "chain", "chain_len", (F.sha2("payload", 256) == F.col("content")).alias("same"))


PATCHED_STREAMS = """WITH v AS (SELECT source AS stream, min(doc_id) AS seq, octet_length(encode(coalesce(text, ''))) >= 600 AND NOT starts_with(text, 'PK' || chr(3) || chr(4)) AS may
  FROM documents GROUP BY source, text),
r AS (SELECT *, sum(CASE WHEN may THEN 0 ELSE 1 END) OVER (PARTITION BY stream ORDER BY seq) AS run FROM v),
n AS (SELECT *, (row_number() OVER (PARTITION BY stream, run ORDER BY seq) - 1) % 6 AS chain_len FROM r)
SELECT stream, seq, max(CASE WHEN chain_len = 0 THEN seq END) OVER (PARTITION BY stream ORDER BY seq) AS chain, chain_len::INTEGER AS chain_len, true AS same FROM n"""


QUERIES = {
    "patched_streams": (patched_streams, PATCHED_STREAMS),
    "entry_reuse": (entry_reuse, ENTRY_REUSE),
    "rebuild_plan": (rebuild_plan, REBUILD_PLAN),
    "referenced_streams": (referenced_streams, REFERENCED_STREAMS),
    "raster_keys": (raster_keys, RASTER_KEYS),
    "patch_closure": (patch_closure, PATCH_CLOSURE),
    "pack_offsets": (pack_offsets, PACK_OFFSETS),
    "stale_temporary": (stale_temporary, STALE_TEMPORARY),
    "sampled_grid": (sampled_grid, SAMPLED_GRID),
    "payload_rules": (payload_rules, PAYLOAD_RULES),
}
