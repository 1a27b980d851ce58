"""Documents as manifests: entries and tiles as content-addressed rows, reuse between versions, rasters and overlays.

A side of a comparison is (entries, tiles): entries (file, entry_pos, entry_path, crc32, size, content) and tiles as
`sources.archives.tiles` gives them; whether they come from a commit or from the working tree makes no difference.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from palimpsest.functions import codecs, labels, png
from palimpsest.operators import diff, raster

#: Longest side of a picture that is shown, and the name of the filter that scales to it.
MOST_SIDE = 2048
FILTER = "box1"
#: A tile with a longer side is not decoded.
MOST_TILE = 1024
BLOCK = 256
COMPOSITE = "mergedimage.png"
#: Fixed value: the colour of changed pixels.
HIGHLIGHT = (224, 123, 57, 128)


# ---- manifests


def manifest(entries: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """(file, entry_pos, entry_path, crc32, size, blob, reused): one row an entry, its content by hash.

    An entry that is not empty and has the checksum and size of the `previous` manifest's entry of that name keeps its blob.
    """
    own = entries.select("file", "entry_pos", "entry_path", "crc32", "size", F.sha2("content", 256).alias("fresh"))
    if previous is None:
        return own.withColumnRenamed("fresh", "blob").withColumn("reused", F.lit(False))
    before = previous.select("file", "entry_path", F.col("crc32").alias("__crc"), F.col("size").alias("__size"), F.col("blob").alias("__blob"))
    both = own.join(before, ["file", "entry_path"], "left").withColumn("reused", reusable(F.col("crc32"), F.col("size"), F.col("__crc"), F.col("__size")))
    blob = F.when(F.col("reused"), F.col("__blob")).otherwise(F.col("fresh"))
    return both.select("file", "entry_pos", "entry_path", "crc32", "size", blob.alias("blob"), "reused")


def reusable(crc: Column, size: Column, old_crc: Column, old_size: Column) -> Column:
    return (size > 0) & crc.eqNullSafe(old_crc) & size.eqNullSafe(old_size)


def tile_refs(tiles: DataFrame) -> DataFrame:
    """(file, entry_path, x, y, compression, hash): a manifest's references to tiles."""
    return tiles.select("file", "entry_path", "x", "y", "compression", F.sha2("data", 256).alias("hash"))


def referenced_streams(entries: DataFrame, refs: DataFrame) -> DataFrame:
    """(stream, content): every stream version that a manifest needs, tiles for tiled entries and blobs for the others."""
    tiled = refs.select("file", "entry_path").distinct()
    blobs = entries.join(tiled, ["file", "entry_path"], "left_anti")
    whole = blobs.select(labels.entry_key(F.col("file"), F.col("entry_path")).alias("stream"), F.col("blob").alias("content"))
    return whole.unionByName(refs.select(labels.tile_key(F.col("file"), F.col("entry_path"), F.col("x"), F.col("y")).alias("stream"), F.col("hash").alias("content")))


def rebuild_plan(target: DataFrame, current: DataFrame, target_tiles: DataFrame, current_tiles: DataFrame) -> DataFrame:
    """(file, entry_pos, entry_path, action, tiles, reused_tiles): how to turn the `current` archive into the `target` one.

    An entry with the same blob is copied as it stands; others are written, and their tiles with equal place and
    hash are taken from the current archive.
    """
    here = current.select("file", "entry_path", F.col("blob").alias("__blob"))
    plan = target.join(here, ["file", "entry_path"], "left").withColumn("action", F.when(F.col("blob").eqNullSafe(F.col("__blob")), "copy").otherwise("write"))
    known = current_tiles.select("file", "entry_path", "x", "y", "hash").distinct().withColumn("__known", F.lit(1))
    counts = target_tiles.join(known, ["file", "entry_path", "x", "y", "hash"], "left").groupBy("file", "entry_path").agg(F.count(F.lit(1)).alias("tiles"), F.count("__known").alias("reused_tiles"))
    plan = plan.join(counts, ["file", "entry_path"], "left")
    return plan.select("file", "entry_pos", "entry_path", "action", F.coalesce("tiles", F.lit(0)).alias("tiles"), F.coalesce("reused_tiles", F.lit(0)).alias("reused_tiles"))


def layer_stems(entries: DataFrame, images: DataFrame) -> DataFrame:
    """(file, stem): the distinct layer files in an archive, without what follows the first dot or slash."""
    named = entries.join(images.select("file", F.concat("name", F.lit("/layers/")).alias("__prefix")), "file")
    rest = named.where(F.col("entry_path").startswith(F.col("__prefix"))).select("file", F.expr("substr(entry_path, length(__prefix) + 1)").alias("rest"))
    return rest.select("file", F.regexp_extract("rest", "^[^./]+", 0).alias("stem")).where("stem <> ''").distinct()


# ---- patches, packs and leftovers


def closed_over_bases(live: DataFrame, versions: DataFrame, most: int) -> DataFrame:
    """(stream, content): `live` versions and all that their patches rest on, `versions` being (stream, content, base).

    A chain of patches has at most `most` steps, so that many joins reach every snapshot.
    """
    bases = versions.where("base is not null").select("stream", "content", "base")
    marked = live.select("stream", "content").distinct()
    step = marked
    for _ in range(most):
        step = step.join(bases, ["stream", "content"]).select("stream", F.col("base").alias("content")).distinct()
        marked = marked.unionByName(step)
    return marked.distinct()


def pack_offsets(objects: DataFrame, pack: str, order: list[str], header: int = 0) -> DataFrame:
    """`objects` with offset: where each begins in its pack, after the header and those before it."""
    before = Window.partitionBy(pack).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return objects.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0)) + header)


def stale_temporary(files: DataFrame, folders: list[str], now_ns: int, seconds: int = 3600) -> DataFrame:
    """Files (path, size, mtime_ns) that end in .tmp, lie right in one of the folders and are older than `seconds`."""
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    return files.where(folder.isin(folders) & F.col("path").endswith(".tmp") & (F.lit(now_ns) - F.col("mtime_ns") > seconds * 1_000_000_000))


# ---- rasters


def default_pixels(entries: DataFrame) -> DataFrame:
    """(file, entry_path, fill): the colour of a tiled entry's untouched parts, from its neighbour with the ending .defaultpixel."""
    found = entries.where(F.col("entry_path").endswith(".defaultpixel"))
    return found.select("file", F.regexp_replace("entry_path", r"\.defaultpixel$", "").alias("entry_path"), labels.default_pixel(F.col("content")).alias("fill")).where("fill is not null")


def blit(canvas: np.ndarray, x: int, y: int, tile: np.ndarray) -> None:
    """Copies a tile to (x, y) of a canvas, both height by width by channels; what lies outside is cut off."""
    height, width = canvas.shape[:2]
    left, top = max(x, 0), max(y, 0)
    right, bottom = min(x + tile.shape[1], width), min(y + tile.shape[0], height)
    if left < right and top < bottom:
        canvas[top:bottom, left:right] = tile[top - y : bottom - y, left - x : right - x]


def tile_pixels(stored: bytes, width: int, height: int) -> np.ndarray | None:
    """The RGBA pixels of a stored tile: a flag byte, then planes of blue, green, red and alpha, packed where the flag is 1."""
    size = width * height * 4
    if not stored or not 0 < width <= MOST_TILE or not 0 < height <= MOST_TILE:
        return None
    planes = stored[1:] if stored[0] == 0 else codecs.unpack(stored[1:], size) if stored[0] == 1 else None
    if planes is None or len(planes) != size:
        return None
    return np.frombuffer(planes, np.uint8).reshape(4, height, width)[[2, 1, 0, 3]].transpose(1, 2, 0)


def stored_tile(planes: bytes) -> bytes:
    """What `tile_pixels` reads: packed where that is shorter."""
    packed = codecs.pack(planes)
    return b"\1" + packed if len(packed) < len(planes) else b"\0" + planes


def capped(rgba: np.ndarray, most: int = MOST_SIDE) -> np.ndarray:
    """Area averages, colours weighed by alpha, such that no side is longer than `most`; smaller pictures stay."""
    height, width = rgba.shape[:2]
    if max(height, width) <= most or not min(height, width):
        return rgba
    scale = most / max(height, width)
    new_h, new_w = (max(1, int(v * scale + 0.5)) for v in (height, width))

    def cells(old: int, new: int) -> tuple[np.ndarray, np.ndarray]:
        start = np.arange(new) * old // new
        end = np.minimum(np.maximum((np.arange(new) + 1) * old // new, start + 1), old)
        return start, end

    (y0, y1), (x0, x1) = cells(height, new_h), cells(width, new_w)
    weighed = rgba.astype(np.int64)
    weighed[..., :3] *= weighed[..., 3:]
    sums = np.zeros((height + 1, width + 1, 4), np.int64)
    sums[1:, 1:] = weighed.cumsum(axis=0).cumsum(axis=1)
    total = sums[y1][:, x1] - sums[y0][:, x1] - sums[y1][:, x0] + sums[y0][:, x0]
    alpha, area = total[..., 3:], ((y1 - y0)[:, None] * (x1 - x0)[None, :])[..., None]
    colour = np.where(alpha > 0, (2 * total[..., :3] + alpha) // np.maximum(2 * alpha, 1), 0)
    return np.concatenate([colour, (2 * alpha + area) // (2 * area)], axis=2).astype(np.uint8)


RASTERS = "file string, entry_path string, width int, height int, key string, png binary"


def layer_rasters(tiles: DataFrame, images: DataFrame, fills: DataFrame) -> DataFrame:
    """RASTERS of tiled entries of four-byte pixels: tiles over the fill colour on the canvas of `images` (file, width, height)."""
    canvas = images.where("width > 0 and height > 0").select("file", F.col("width").alias("cw"), F.col("height").alias("ch"))
    rows = tiles.where("pixel_size = 4").join(canvas, "file").join(fills, ["file", "entry_path"], "left")
    rows = rows.withColumn("hash", F.sha2("data", 256))
    return rows.groupBy("file", "entry_path").applyInPandas(_raster, RASTERS)


def _raster(rows: pd.DataFrame) -> pd.DataFrame:
    """One layer: its canvas is bounded by the archive's limit on sides."""
    first = rows.iloc[0]
    width, height = int(first["cw"]), int(first["ch"])
    fill = first["fill"] if isinstance(first["fill"], bytes) else bytes(4)
    canvas = np.empty((height, width, 4), np.uint8)
    canvas[:] = np.frombuffer(fill, np.uint8)
    for row in rows.sort_values("tile_pos").itertuples():
        pixels = tile_pixels(row.data, int(row.tw), int(row.th))
        if pixels is not None:
            blit(canvas, int(row.x), int(row.y), pixels)
    shown = capped(canvas)
    key = raster_key(first["entry_path"], zip(rows["x"], rows["y"], rows["hash"], strict=True), width, height, fill)
    picture = png.encode(shown.shape[1], shown.shape[0], np.ascontiguousarray(shown).tobytes())
    return pd.DataFrame({"file": [first["file"]], "entry_path": [first["entry_path"]], "width": [shown.shape[1]], "height": [shown.shape[0]], "key": [key], "png": [picture]})


def raster_key(entry_path: str, tiles: Iterable[tuple[int, int, str]], width: int, height: int, fill: bytes = bytes(4)) -> str:
    """What a layer's picture depends on: its tiles, canvas and fill, the longest side and the filter."""
    parts = ["layer", entry_path, f"{width}x{height}", str(MOST_SIDE), FILTER, fill.hex(), *[f"{x},{y},{h}" for x, y, h in sorted(tiles)]]
    return hashlib.sha256("\0".join(parts).encode()).hexdigest()


def layer_key(entry_path: Column, width: Column, height: Column, fill: Column, tiles: Column) -> Column:
    """`raster_key` as an expression; `tiles` is an array of (x, y, hash), `fill` four bytes or null."""
    at = F.transform(F.array_sort(tiles), lambda t: F.concat_ws(",", t["x"].cast("string"), t["y"].cast("string"), t["hash"]))
    size = F.concat(width.cast("string"), F.lit("x"), height.cast("string"))
    fixed = [F.lit("layer"), entry_path, size, F.lit(str(MOST_SIDE)), F.lit(FILTER), F.coalesce(F.lower(F.hex(fill)), F.lit("00000000"))]
    return F.sha2(F.array_join(F.concat(F.array(*fixed), at), "\0"), 256)


def composite_key(content: Column) -> Column:
    return F.sha2(F.concat_ws("\0", F.lit("composite"), content, F.lit(str(MOST_SIDE)), F.lit(FILTER)), 256)


def overlay_key(before: Column, after: Column) -> Column:
    return F.sha2(F.concat_ws("\0", F.lit("diffmask"), before, after, F.lit(str(MOST_SIDE)), F.lit(FILTER)), 256)


# ---- composites


BLOCKS = "file string, entry_path string, width int, height int, x int, y int, pixels binary"


def composite_blocks(entries: DataFrame) -> DataFrame:
    """BLOCKS of 256 pixels a side, RGBA, of the composite of each file; one that is no plain picture has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file, path, content in zip(batch["file"], batch["entry_path"], batch["content"], strict=True):
                found = png.decode(content)
                if found is None:
                    continue
                width, height, raw = found
                pixels = np.frombuffer(raw, np.uint8).reshape(height, width, 4)
                for y in range(0, height, BLOCK):
                    for x in range(0, width, BLOCK):
                        rows.append((file, path, width, height, x, y, pixels[y : y + BLOCK, x : x + BLOCK].tobytes()))
            yield pd.DataFrame(rows, columns=["file", "entry_path", "width", "height", "x", "y", "pixels"])

    return entries.where(F.col("entry_path") == COMPOSITE).select("file", "entry_path", "content").mapInPandas(run, BLOCKS)


def composite_png(blocks: DataFrame) -> DataFrame:
    """(file, entry_path, png): composites put together again; exact pixels. A block of another size than its place raises."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        width, height = int(rows["width"].iloc[0]), int(rows["height"].iloc[0])
        canvas = np.zeros((height, width, 4), np.uint8)
        for x, y, raw in zip(rows["x"], rows["y"], rows["pixels"], strict=True):
            w, h = min(BLOCK, width - x), min(BLOCK, height - y)
            if len(raw) != w * h * 4:
                raise ValueError("a block does not fill its place")
            blit(canvas, x, y, np.frombuffer(raw, np.uint8).reshape(h, w, 4))
        return pd.DataFrame({"file": [rows["file"].iloc[0]], "entry_path": [rows["entry_path"].iloc[0]], "png": [png.encode(width, height, canvas.tobytes())]})

    return blocks.groupBy("file", "entry_path").applyInPandas(build, "file string, entry_path string, png binary")


# ---- overlays


OVERLAY = "mask binary, outline string, x double, y double, w double, h double"


def overlay(before: bytes, after: bytes) -> tuple | None:
    """(mask as PNG, outline path or None, x, y, w, h of the changed box as shares, or None) of two pictures; None where one cannot be read."""
    sides = [png.decode(p) for p in (before, after)]
    if None in sides:
        return None
    old, new = (capped(np.frombuffer(raw, np.uint8).reshape(h, w, 4)) for w, h, raw in sides)
    height, width = new.shape[:2]
    rows = np.minimum(np.arange(height) * old.shape[0] // height, old.shape[0] - 1)
    columns = np.minimum(np.arange(width) * old.shape[1] // width, old.shape[1] - 1)
    changed = (np.abs(new.astype(np.int16) - old[rows][:, columns].astype(np.int16)) > raster.TOLERANCE).any(axis=2)
    mask = np.zeros((height, width, 4), np.uint8)
    mask[changed] = HIGHLIGHT
    picture = png.encode(width, height, mask.tobytes())
    if not changed.any():
        return picture, None, None, None, None, None
    ys, xs = np.flatnonzero(changed.any(axis=1)), np.flatnonzero(changed.any(axis=0))
    box = (xs[0] / width, ys[0] / height, (xs[-1] - xs[0] + 1) / width, (ys[-1] - ys[0] + 1) / height)
    return picture, raster.outline_of(changed), *map(float, box)


def overlays(pairs: DataFrame) -> DataFrame:
    """`pairs` (before, after, ...) of PNG bytes with the columns of OVERLAY in place of the pictures, null where there is none."""
    others = [c for c in pairs.columns if c not in ("before", "after")]
    schema = pairs.select(*others, *[F.lit(None).cast(t).alias(n) for n, t in (c.split() for c in OVERLAY.split(", "))]).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [overlay(b, a) if b is not None and a is not None else None for b, a in zip(batch["before"], batch["after"], strict=True)]
            columns = list(zip(*[f or (None,) * 6 for f in found], strict=True)) or [()] * 6
            made = {n: pd.Series(list(c), dtype=object) for n, c in zip(("mask", "outline", "x", "y", "w", "h"), columns, strict=True)}
            yield pd.concat([batch[others].reset_index(drop=True), pd.DataFrame(made)], axis=1)

    return pairs.mapInPandas(run, schema)


# ---- comparison of two versions of documents


def layer_table(layers: DataFrame, images: DataFrame) -> DataFrame:
    """`layers` with id and the path of each one's data entry."""
    named = layers.join(images.select("file", F.col("name").alias("image")), "file")
    return named.withColumn("id", labels.layer_id(F.col("uuid"), F.col("name"))).withColumn("entry_path", F.concat("image", F.lit("/layers/"), "filename"))


def art_changes(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> DataFrame:
    """(file, place, id, name, opacity, blend, change, visible, kind, entry_path, old_entry, x, y, w, h): the layers of the new
    side in their order, then removed ones. Sides are {layers, images, tiles} of the same files; a file whose old side is missing has added layers.
    """
    known = old["images"].select("file").distinct()
    was = layer_table(old["layers"], old["images"])
    now = layer_table(new["layers"], new["images"])
    first = was.groupBy("file", "id").agg(F.min_by(F.struct("opacity", "blend", "name", "entry_path"), "pos").alias("o"))
    changed = diff.changed_entries(_index(old["tiles"]), _index(new["tiles"]), 0).select(F.col("entry.file").alias("file"), F.col("entry.entry_path").alias("entry_path"), F.lit(True).alias("__changed"))
    meta = ~(F.col("o.opacity").eqNullSafe(F.col("opacity")) & F.col("o.blend").eqNullSafe(F.col("blend")) & F.col("o.name").eqNullSafe(F.col("name")))
    change = F.when(F.col("o").isNull(), "added").when(meta | F.col("__changed"), "modified").otherwise("unchanged")
    there = now.join(first, ["file", "id"], "left").join(changed, ["file", "entry_path"], "left").withColumn("change", change)
    there = there.join(_boxes(new["tiles"], new["images"]), ["file", "entry_path"], "left")
    gone = was.join(now.select("file", "id").distinct(), ["file", "id"], "left_anti").join(new["images"].select("file").distinct(), "file", "left_semi")
    gone = gone.join(known, "file", "left_semi").join(_boxes(old["tiles"], new["images"]), ["file", "entry_path"], "left")

    def shown(rows: DataFrame, side: int, changes: Column, entry: Column, before: Column) -> DataFrame:
        place = F.struct(F.lit(side).alias("side"), "pos").alias("place")
        return rows.select("file", place, "id", "name", labels.opacity_percent(F.col("opacity")).alias("opacity"), labels.blend_mode(F.col("blend")).alias("blend"), changes.alias("change"), "visible", "kind", entry.alias("entry_path"), before.alias("old_entry"), "x", "y", "w", "h")

    none = F.lit(None).cast("string")
    return shown(there, 0, F.col("change"), F.col("entry_path"), F.col("o.entry_path")).unionByName(shown(gone, 1, F.lit("removed"), none, F.col("entry_path")))


def _index(tiles: DataFrame) -> DataFrame:
    return tiles.select(F.struct("file", "entry_path").alias("entry"), "x", "y", F.sha2("data", 256).alias("hash"))


def _boxes(tiles: DataFrame, images: DataFrame) -> DataFrame:
    """(file, entry_path, x, y, w, h): the painted box of each entry inside its canvas; none where nothing is left of it."""
    box = tiles.groupBy("file", "entry_path").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max(F.col("x") + F.col("tw")).alias("x1"), F.max(F.col("y") + F.col("th")).alias("y1"))
    cut = box.join(images.select("file", "width", "height"), "file").selectExpr("file", "entry_path", "greatest(x0, 0) AS x", "greatest(y0, 0) AS y", "least(x1, width) AS r", "least(y1, height) AS b")
    return cut.selectExpr("file", "entry_path", "x", "y", "r - x AS w", "b - y AS h").where("w > 0 and h > 0")


def changed_regions(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> DataFrame:
    """(file, x, y, w, h): the box around all changed tiles of a file as shares of its canvas."""
    was = _index(old["tiles"]).withColumnRenamed("hash", "__was")
    sized = new["tiles"].select(F.struct("file", "entry_path").alias("entry"), "file", "x", "y", "tw", "th", F.sha2("data", 256).alias("hash"))
    differs = sized.join(was, ["entry", "x", "y"], "left").where(~F.col("hash").eqNullSafe(F.col("__was"))).join(old["images"].select("file").distinct(), "file", "left_semi")
    box = differs.groupBy("file").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max(F.col("x") + F.col("tw")).alias("x1"), F.max(F.col("y") + F.col("th")).alias("y1"))
    rows = box.join(new["images"].select("file", "width", "height"), "file").where("width > 0 and height > 0")
    share = lambda low, high, side: f"greatest(0, least(1, (least({high}, {side}) - greatest({low}, 0)) / {side}))"
    return rows.selectExpr("file", "greatest(x0, 0) / width AS x", "greatest(y0, 0) / height AS y", f"{share('x0', 'x1', 'width')} AS w", f"{share('y0', 'y1', 'height')} AS h")


@F.pandas_udf(BinaryType())
def capped_png(picture: pd.Series) -> pd.Series:
    """Plain pictures scaled to the longest side that is shown; null for others."""

    def one(data: bytes | None) -> bytes | None:
        found = None if data is None else png.decode(data)
        if found is None:
            return None
        width, height, raw = found
        shown = capped(np.frombuffer(raw, np.uint8).reshape(height, width, 4))
        return png.encode(shown.shape[1], shown.shape[0], np.ascontiguousarray(shown).tobytes())

    return pd.Series([one(d) for d in picture], dtype=object)
