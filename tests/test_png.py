from __future__ import annotations

import random
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.functions import png


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.randoms())
def test_round_trip(width, height, rng):
    rgba = bytes(rng.randrange(256) for _ in range(width * height * 4))
    assert png.decode(png.encode(width, height, rgba)) == (width, height, rgba)


@pytest.mark.parametrize("kind", [0, 1, 2, 3, 4])
def test_every_filter(kind):
    rng = random.Random(kind)
    width, height, step = 5, 4, 3
    want = [[rng.randrange(256) for _ in range(width * step)] for _ in range(height)]
    rows = b""
    for y, row in enumerate(want):
        up = want[y - 1] if y else [0] * len(row)
        line = []
        for x, v in enumerate(row):
            left, corner = (row[x - step], up[x - step]) if x >= step else (0, 0)
            p = left + up[x] - corner
            paeth = min((left, up[x], corner), key=lambda c: abs(p - c))
            line.append((v - (0, left, up[x], (left + up[x]) // 2, paeth)[kind]) & 255)
        rows += bytes([kind, *line])
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    data = png.SIGNATURE + png._chunk(b"IHDR", head) + png._chunk(b"IDAT", zlib.compress(rows)) + png._chunk(b"IEND", b"")
    found = png.decode(data)
    assert found[:2] == (width, height)
    assert [[c for k in range(width) for c in found[2][(y * width + k) * 4 :][:3]] for y in range(height)] == want


def test_what_is_not_plain_is_null(spark):
    good = png.encode(2, 1, bytes(8))
    rows = [(good,), (good[:-5],), (b"no png",), (None,), (good.replace(b"IDAT", b"iCCP"),)]
    df = spark.createDataFrame(rows, "d binary").select(png.png_pixels("d").alias("p"), png.png_size(png.F.col("d")).alias("s"), png.data_url(png.F.col("d")).alias("u"))
    got = df.collect()
    assert [r.p is not None for r in got] == [True, False, False, False, False]
    assert (got[0].s.width, got[0].s.height) == (2, 1) and got[0].u.startswith("data:image/png;base64,iVBOR") and got[3].u is None
