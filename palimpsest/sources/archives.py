"""Document archives: zip entries, tiled blocks, layer metadata. Files are rows (file, content)."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: An archive with an entry that inflates to more is refused: reading it raises.
MOST_BYTES = 2 << 30
#: A canvas wider or higher than this is refused.
MOST_SIDE = 32768
ENTRIES = "file string, entry_pos int, entry_path string, crc32 long, size long, content binary"
TILES = "file string, entry_path string, tw int, th int, pixel_size int, tile_pos int, x long, y long, compression string, data binary"
LAYERS = "file string, pos int, name string, uuid string, opacity long, blend string, visible boolean, kind string, filename string"
IMAGES = "file string, name string, width long, height long, dpi double, color_model string, color_profile string"


def entries(files: DataFrame) -> DataFrame:
    """The entries of each zip in archive order; a file that is no zip has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["file"], batch["content"], strict=True):
                yield pd.DataFrame([(file, *e) for e in zip_entries(content)], columns=["file", "entry_pos", "entry_path", "crc32", "size", "content"])

    return files.select("file", "content").mapInPandas(run, ENTRIES)


def zip_entries(content: bytes) -> Iterator[tuple]:
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            for pos, info in enumerate(archive.infolist()):
                if info.is_dir():
                    continue
                if info.file_size > MOST_BYTES:
                    raise ValueError(f"{info.filename} inflates to {info.file_size} bytes, over the limit of {MOST_BYTES}")
                yield pos, info.filename, info.CRC, info.file_size, archive.read(info)
    except (zipfile.BadZipFile, zlib.error, EOFError):
        return


def tiles(archive_entries: DataFrame) -> DataFrame:
    """The tiles of tiled entries; a broken block has none."""
    tiled = archive_entries.where(F.startswith(F.col("content"), F.lit(b"VERSION ")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file, path, content in zip(batch["file"], batch["entry_path"], batch["content"], strict=True):
                try:
                    rows += [(file, path, *t) for t in parse_tiles(content)]
                except (ValueError, KeyError, IndexError):
                    continue
            yield pd.DataFrame(rows, columns=["file", "entry_path", "tw", "th", "pixel_size", "tile_pos", "x", "y", "compression", "data"])

    return tiled.select("file", "entry_path", "content").mapInPandas(run, TILES)


def parse_tiles(block: bytes) -> list[tuple]:
    """(tile width, height, pixel size, pos, x, y, compression, data) of each tile: five header lines, then a line and bytes a tile."""
    at = 0

    def line() -> str:
        nonlocal at
        end = block.index(b"\n", at)
        text, at = block[at:end].decode(), end + 1
        return text

    head = dict(line().split(" ", 1) for _ in range(5))
    count = int(head["DATA"])
    if count * 4 > len(block):
        raise ValueError("more tiles than bytes")
    out = []
    for pos in range(count):
        x, y, compression, size = line().split(",")
        data = block[at : at + int(size)]
        if len(data) != int(size):
            raise ValueError("the block ends inside a tile")
        at += int(size)
        out.append((int(head["TILEWIDTH"]), int(head["TILEHEIGHT"]), int(head["PIXELSIZE"]), pos, int(x), int(y), compression, data))
    return out


def tiled_block(tiles: list[tuple[int, int, str, bytes]], width: int = 64, height: int = 64, pixel_size: int = 4) -> bytes:
    """The block that `parse_tiles` reads, from (x, y, compression, data)."""
    head = f"VERSION 2\nTILEWIDTH {width}\nTILEHEIGHT {height}\nPIXELSIZE {pixel_size}\nDATA {len(tiles)}\n".encode()
    return head + b"".join(f"{x},{y},{c},{len(d)}\n".encode() + d for x, y, c, d in tiles)


def _document(content: bytes) -> ET.Element | None:
    try:
        root = ET.fromstring(content)
    except ET.ParseError:
        return None
    for node in root.iter():
        node.tag = node.tag.rsplit("}", 1)[-1]
    return root


def _metadata(archive_entries: DataFrame, parse, schema: str) -> DataFrame:  # noqa: ANN001
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(file, *r) for file, content in zip(batch["file"], batch["content"], strict=True) if (root := _document(content)) is not None for r in parse(root)]
            yield pd.DataFrame(rows, columns=columns)

    return archive_entries.where("entry_path = 'maindoc.xml'").select("file", "content").mapInPandas(run, schema)


def _number(text: str | None, default: int) -> int:
    try:
        return int(text)
    except (TypeError, ValueError):
        return default


def layers(archive_entries: DataFrame) -> DataFrame:
    """All layers at any depth, in document order; opacity 255, blend normal and visible unless said otherwise."""

    def parse(root: ET.Element) -> Iterator[tuple]:
        for pos, n in enumerate(root.iter("layer")):
            yield pos, n.get("name", ""), n.get("uuid", ""), _number(n.get("opacity"), 255), n.get("compositeop", "normal"), n.get("visible") != "0", n.get("nodetype", ""), n.get("filename", "")

    return _metadata(archive_entries, parse, LAYERS)


def images(archive_entries: DataFrame) -> DataFrame:
    """Canvas size and colour space; a canvas beyond MOST_SIDE has no row."""

    def parse(root: ET.Element) -> Iterator[tuple]:
        n = next(root.iter("IMAGE"), None)
        if n is None:
            return
        width, height = _number(n.get("width"), 0), _number(n.get("height"), 0)
        if max(width, height) <= MOST_SIDE:
            yield n.get("name", ""), width, height, float(n.get("x-res", "0") or 0), n.get("colorspacename", ""), n.get("profile", "")

    return _metadata(archive_entries, parse, IMAGES)


def pack(archive_entries: DataFrame) -> DataFrame:
    """(file, content): zips made of entries (file, entry_pos, entry_path, content); mimetype is stored, the rest deflated."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as archive:
            for path, content in rows.sort_values("entry_pos")[["entry_path", "content"]].itertuples(index=False):
                info = zipfile.ZipInfo(path)
                info.compress_type = zipfile.ZIP_STORED if path == "mimetype" else zipfile.ZIP_DEFLATED
                archive.writestr(info, content)
        return pd.DataFrame({"file": [rows["file"].iloc[0]], "content": [out.getvalue()]})

    return archive_entries.select("file", "entry_pos", "entry_path", "content").groupBy("file").applyInPandas(build, "file string, content binary")
