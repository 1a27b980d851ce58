"""Colour palettes from files: text palettes natively, binary and zipped ones by small parsers in tasks."""

from __future__ import annotations

import io
import struct
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the colour shown for colour spaces that are not read.
OTHER_SPACE = (128, 128, 128)
SWATCHES = "file string, pos long, name string, r int, g int, b int"
ENTRY = r"^\s*([+-]?[0-9]+)\s+([+-]?[0-9]+)\s+([+-]?[0-9]+)(?:\s+(.*?))?\s*$"


def gpl(files: DataFrame) -> DataFrame:
    """(file, pos, name, r, g, b) of text palettes (file, text): channels are clamped, an empty name is the colour; a
    line with a channel that is no 32-bit number is skipped."""
    lines = files.select("file", F.posexplode(F.split("text", "\r?\n")).alias("line", "text")).where(F.col("text").rlike(ENTRY))
    number = lambda k: F.regexp_extract("text", ENTRY, k).try_cast("int")
    lines = lines.where(number(1).isNotNull() & number(2).isNotNull() & number(3).isNotNull())
    channel = lambda k: F.greatest(F.lit(0), F.least(F.lit(255), number(k)))
    found = lines.select("file", "line", F.regexp_replace(F.regexp_extract("text", ENTRY, 4), r"\s+", " ").alias("name"), channel(1).alias("r"), channel(2).alias("g"), channel(3).alias("b"))
    hexed = F.concat(F.lit("#"), *[F.lpad(F.hex(c), 2, "0") for c in ("r", "g", "b")])
    pos = F.row_number().over(Window.partitionBy("file").orderBy("line")) - 1
    return found.select("file", pos.cast("bigint").alias("pos"), F.when(F.col("name") == "", hexed).otherwise(F.col("name")).alias("name"), "r", "g", "b")


def gpl_columns(files: DataFrame) -> DataFrame:
    """(file, columns) of text palettes: the last `Columns:` line, 0 where it is no number or missing."""
    value = r"^\s*Columns:(.*)$"
    lines = files.select("file", F.posexplode(F.split("text", "\r?\n")).alias("line", "text"))
    number = F.trim(F.regexp_extract("text", value, 1)).try_cast("int")
    last = F.max_by(F.coalesce(F.when(number >= 0, number), F.lit(0)), F.when(F.col("text").rlike(value), F.col("line")))
    return lines.groupBy("file").agg(F.coalesce(last, F.lit(0)).alias("columns"))


def columns_of_both(old: Column, new: Column) -> Column:
    """The columns to show two versions with: the new one's if it has any, else the old one's."""
    return F.coalesce(F.when(new > 0, new), old, F.lit(0))


def swatches(files: DataFrame) -> DataFrame:
    """(file, pos, name, r, g, b) of palettes (file, content) of any kind, by their ending."""
    text = F.lower("file").endswith(".gpl")
    readable = files.where(text).select("file", F.expr("try_validate_utf8(cast(content as string))").alias("text")).where("text is not null")
    return gpl(readable).unionByName(binary(files.where(~text)))


def binary(files: DataFrame) -> DataFrame:
    """Swatches of .aco, .ase and .kpl files (file, content); a file that cannot be read has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file, content in zip(batch["file"], batch["content"], strict=True):
                rows += [(file, pos, *swatch) for pos, swatch in enumerate(parse(file, content))]
            yield pd.DataFrame(rows, columns=["file", "pos", "name", "r", "g", "b"])

    return files.select("file", "content").mapInPandas(run, SWATCHES)


def parse(file: str, content: bytes) -> list[tuple[str, int, int, int]]:
    """(name, r, g, b) of each swatch, by the file's extension."""
    reader = {"aco": _aco, "ase": _ase, "kpl": _kpl}.get(file.rsplit(".", 1)[-1].lower())
    try:
        return reader(content) if reader else []
    except (struct.error, ValueError, KeyError, IndexError, zipfile.BadZipFile, ET.ParseError):
        return []


def _byte(v: float) -> int:
    return int(max(0.0, min(1.0, v)) * 255 + 0.5)


def _named(name: str, rgb: tuple[int, int, int]) -> tuple[str, int, int, int]:
    return (name or "#%02X%02X%02X" % rgb, *rgb)


def _cmyk(c: float, m: float, y: float, k: float) -> tuple[int, int, int]:
    return tuple(_byte((1 - v) * (1 - k)) for v in (c, m, y))


def _aco(data: bytes) -> list[tuple[str, int, int, int]]:
    """Version 1: a count and ten bytes a colour. Version 2 may follow with the names; where it is broken the colours stay."""
    version, count = struct.unpack_from(">HH", data)
    if version != 1:
        return []
    colours = [struct.unpack_from(">HHHHH", data, 4 + 10 * k) for k in range(count)]
    try:
        names = _aco_names(data, 4 + 10 * count)
    except struct.error:
        names = []
    names = [*names, *[""] * count]
    out = []
    for name, (space, a, *rest) in zip(names, colours, strict=False):
        if space == 0:
            rgb = tuple(_byte(v / 65535) for v in (a, *rest[:2]))
        elif space == 2:  # stored inverted
            rgb = _cmyk(*(1 - v / 65535 for v in (a, *rest)))
        elif space == 8:
            rgb = (_byte(a / 10000),) * 3
        else:
            rgb = OTHER_SPACE
        out.append(_named(name, rgb))
    return out


def _aco_names(data: bytes, at: int) -> list[str]:
    if len(data) == at or struct.unpack_from(">H", data, at)[0] != 2:
        return []
    names, count = [], struct.unpack_from(">H", data, at + 2)[0]
    at += 4
    for _ in range(count):
        n = struct.unpack_from(">I", data, at + 10)[0]
        at += 14 + 2 * n
        if at > len(data):
            raise struct.error("the file ends inside a name")
        names.append(_utf16(data[at - 2 * n : at]))
    return names


def _utf16(raw: bytes) -> str:
    """UTF-16 up to the first zero unit."""
    units = [raw[k : k + 2] for k in range(0, len(raw) - 1, 2)]
    end = units.index(b"\0\0") if b"\0\0" in units else len(units)
    return b"".join(units[:end]).decode("utf-16-be", "replace")


def _ase(data: bytes) -> list[tuple[str, int, int, int]]:
    """Blocks of a type, a length and a body; colour blocks are type 1."""
    if data[:4] != b"ASEF":
        return []
    out, at = [], 12
    for _ in range(struct.unpack_from(">I", data, 8)[0]):
        kind, size = struct.unpack_from(">HI", data, at)
        body = data[at + 6 : at + 6 + size]
        at += 6 + size
        if len(body) < size:
            return []
        if kind == 1 and (found := _ase_colour(body)):
            out.append(found)
    return out


def _ase_colour(body: bytes) -> tuple[str, int, int, int] | None:
    try:
        n = struct.unpack_from(">H", body)[0]
        model, values = body[2 + 2 * n : 6 + 2 * n], body[6 + 2 * n :]
        if model == b"RGB ":
            rgb = tuple(map(_byte, struct.unpack_from(">fff", values)))
        elif model == b"CMYK":
            rgb = _cmyk(*struct.unpack_from(">ffff", values))
        elif model == b"Gray":
            rgb = (_byte(struct.unpack_from(">f", values)[0]),) * 3
        elif model == b"LAB ":
            rgb = lab_to_rgb(*struct.unpack_from(">fff", values))
        else:
            return None
    except struct.error:
        return None
    return _named(_utf16(body[2 : 2 + 2 * n]), rgb)


def lab_to_rgb(light: float, a: float, b: float) -> tuple[int, int, int]:
    """CIE Lab (D50) to sRGB bytes."""
    fy = (light + 16) / 116
    cube = lambda t: t**3 if t > 6 / 29 else 3 * (6 / 29) ** 2 * (t - 4 / 29)
    # fixed values: the D50 white point and the D50-adapted matrix of sRGB
    x, y, z = 0.9642 * cube(fy + a / 500), cube(fy), 0.8249 * cube(fy - b / 200)
    linear = (3.1338561 * x - 1.6168667 * y - 0.4906146 * z, -0.9787684 * x + 1.9161415 * y + 0.0334540 * z, 0.0719453 * x - 0.2289914 * y + 1.4052427 * z)
    return tuple(_byte(12.92 * v if v <= 0.0031308 else 1.055 * max(v, 0) ** (1 / 2.4) - 0.055) for v in linear)


def _kpl(data: bytes) -> list[tuple[str, int, int, int]]:
    """A zip with colorset.xml; entries count at any depth, and take the first child whose colour space is known."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        root = ET.fromstring(archive.read("colorset.xml"))
    out = []
    for entry in root.iter("ColorSetEntry"):
        rgb = next((c for c in map(_kpl_colour, entry) if c), None)
        if rgb is not None:
            out.append(_named(entry.get("name", "").strip(), rgb))
    return out


def _kpl_colour(node: ET.Element) -> tuple[int, int, int] | None:
    try:
        if node.tag in ("RGB", "sRGB"):
            return tuple(_byte(float(node.get(c, ""))) for c in "rgb")
        if node.tag in ("Gray", "GRAY"):
            return (_byte(float(node.get("g", ""))),) * 3
        if node.tag == "CMYK":
            return _cmyk(*(float(node.get(c, "")) for c in "cmyk"))
    except ValueError:
        pass
    return None
