"""Tile codecs as pandas UDFs: LZF, planar pixels, zstd."""

from __future__ import annotations

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType


def pack(data: bytes) -> bytes:
    """LZF: literal runs of up to 32 bytes, and copies of 3 to 264 bytes from up to 8 KiB back."""
    seen: dict[bytes, int] = {}
    out, literal, i = bytearray(), bytearray(), 0

    def flush() -> None:
        for k in range(0, len(literal), 32):
            run = literal[k : k + 32]
            out.append(len(run) - 1)
            out.extend(run)
        literal.clear()

    while i < len(data):
        key = data[i : i + 3]
        at = seen.get(key, -1) if len(key) == 3 else -1
        seen[key] = i
        if at < 0 or i - at > 8192:
            literal.append(data[i])
            i += 1
            continue
        n = 3
        while n < 264 and i + n < len(data) and data[at + n] == data[i + n]:
            n += 1
        flush()
        back = i - at - 1
        if n - 2 < 7:
            out.append(n - 2 << 5 | back >> 8)
        else:
            out += bytes((7 << 5 | back >> 8, n - 9))
        out.append(back & 255)
        i += n
    flush()
    return bytes(out)


def unpack(data: bytes, size: int) -> bytes | None:
    """The bytes that `pack` was given; null if the stream does not make `size` bytes."""
    out, i = bytearray(), 0
    try:
        while i < len(data):
            control = data[i]
            i += 1
            if control < 32:
                if i + control + 1 > len(data):
                    return None
                out += data[i : i + control + 1]
                i += control + 1
                continue
            n = control >> 5
            if n == 7:
                n += data[i]
                i += 1
            at = len(out) - ((control & 31) << 8 | data[i]) - 1
            i += 1
            if at < 0:
                return None
            for k in range(n + 2):
                out.append(out[at + k])
    except IndexError:
        return None
    return bytes(out) if len(out) == size else None


@F.pandas_udf(BinaryType())
def lzf_compress(data: pd.Series) -> pd.Series:
    return data.map(pack, na_action="ignore")


@F.pandas_udf(BinaryType())
def lzf_decompress(data: pd.Series, size: pd.Series) -> pd.Series:
    return pd.Series([None if d is None else unpack(d, int(n)) for d, n in zip(data, size, strict=True)], dtype=object)


@F.pandas_udf(BinaryType())
def planar_to_rgba(planes: pd.Series) -> pd.Series:
    """Planes of blue, green, red and alpha, one after another, to red, green, blue, alpha by pixel."""
    return planes.map(lambda p: np.frombuffer(p, np.uint8).reshape(4, -1)[[2, 1, 0, 3]].T.tobytes() if len(p) % 4 == 0 else None, na_action="ignore")


@F.pandas_udf(BinaryType())
def rgba_to_planar(pixels: pd.Series) -> pd.Series:
    return pixels.map(lambda p: np.frombuffer(p, np.uint8).reshape(-1, 4).T[[2, 1, 0, 3]].tobytes() if len(p) % 4 == 0 else None, na_action="ignore")


@F.pandas_udf(BinaryType())
def zstd_compress(data: pd.Series) -> pd.Series:
    return data.map(zstandard.ZstdCompressor(3).compress, na_action="ignore")


@F.pandas_udf(BinaryType())
def zstd_decompress(data: pd.Series) -> pd.Series:
    return data.map(zstandard.ZstdDecompressor().decompress, na_action="ignore")
