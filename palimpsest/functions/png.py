"""PNG pixels as pandas UDFs: 8-bit RGB and RGBA without interlacing, on zlib and numpy."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: A picture of more pixels is refused.
MOST_PIXELS = 32768 * 32768
CHANNELS = {2: 3, 6: 4}


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(width: int, height: int, rgba: bytes) -> bytes:
    """An RGBA picture; `rgba` holds the rows from top to bottom."""
    if len(rgba) != width * height * 4:
        raise ValueError("the pixels do not fill the picture")
    rows = np.zeros((height, 1 + width * 4), np.uint8)  # filter 0 before each row
    rows[:, 1:] = np.frombuffer(rgba, np.uint8).reshape(height, width * 4)
    head = struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + _chunk(b"IEND", b"")


def decode(data: bytes) -> tuple[int, int, bytes] | None:
    """(width, height, rgba), or None for what is not a plain 8-bit RGB or RGBA picture."""
    if not data.startswith(SIGNATURE):
        return None
    at, head, packed = 8, None, []
    try:
        while at < len(data):
            size, kind = struct.unpack_from(">I4s", data, at)
            body = data[at + 8 : at + 8 + size]
            if len(body) != size or zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + size)[0]:
                return None
            at += 12 + size
            if kind == b"IHDR":
                head = struct.unpack(">IIBBBBB", body)
            elif kind == b"IDAT":
                packed.append(body)
            elif kind in (b"iCCP", b"PLTE"):
                return None
        width, height, depth, colour, *rest = head
        if depth != 8 or colour not in CHANNELS or rest != [0, 0, 0] or not 0 < width * height <= MOST_PIXELS:
            return None
        step = CHANNELS[colour]
        length = height * (1 + width * step)
        raw = zlib.decompressobj().decompress(b"".join(packed), length + 1)
        if len(raw) != length:
            return None
    except (struct.error, zlib.error, TypeError):
        return None
    rows = np.frombuffer(raw, np.uint8).reshape(height, 1 + width * step)
    pixels = _unfiltered(rows[:, 0], rows[:, 1:], step)
    if pixels is None:
        return None
    pixels = pixels.reshape(height, width, step)
    if step == 3:
        pixels = np.dstack([pixels, np.full((height, width), 255, np.uint8)])
    return width, height, pixels.tobytes()


def _unfiltered(kinds: np.ndarray, rows: np.ndarray, step: int) -> np.ndarray | None:
    """Undoes the filter of each row: none, left, up, average, or the nearest of left, up and corner."""
    out = np.zeros_like(rows)
    above = np.zeros(rows.shape[1], np.uint8)
    for y, (kind, row) in enumerate(zip(kinds.tolist(), rows, strict=True)):
        if kind == 0:
            line = row
        elif kind == 1:
            line = np.cumsum(row.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            line = row + above
        elif kind in (3, 4):
            line = row.astype(np.int32)
            up = above.astype(np.int32)
            for x in range(len(line)):
                left = int(line[x - step]) if x >= step else 0
                corner = int(up[x - step]) if x >= step else 0
                if kind == 3:
                    guess = (left + int(up[x])) // 2
                else:
                    p = left + int(up[x]) - corner
                    guess = min((abs(p - left), 0, left), (abs(p - up[x]), 1, int(up[x])), (abs(p - corner), 2, corner))[2]
                line[x] = (int(line[x]) + guess) & 255
            line = line.astype(np.uint8)
        else:
            return None
        out[y] = above = line
    return out


@F.pandas_udf(BinaryType())
def to_png(width: pd.Series, height: pd.Series, rgba: pd.Series) -> pd.Series:
    """Null where the pixels do not fill the picture."""
    rows = zip(width, height, rgba, strict=True)
    return pd.Series([encode(int(w), int(h), p) if p is not None and len(p) == w * h * 4 else None for w, h, p in rows], dtype=object)


@F.pandas_udf(BinaryType())
def png_pixels(data: pd.Series) -> pd.Series:
    """The RGBA pixels of plain pictures."""
    return pd.Series([None if d is None or (found := decode(d)) is None else found[2] for d in data], dtype=object)


def png_size(data: Column) -> Column:
    """(width, height) read from the header, natively."""
    number = lambda at: F.conv(F.hex(F.substring(data, at, 4)), 16, 10).cast("bigint")
    return F.when(F.substring(data, 1, 8) == F.lit(SIGNATURE), F.struct(number(17).alias("width"), number(21).alias("height")))


def data_url(png: Column) -> Column:
    return F.concat(F.lit("data:image/png;base64,"), F.base64(png))
