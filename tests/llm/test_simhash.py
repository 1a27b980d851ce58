from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from palimpsest.llm import simhash as s
from palimpsest.llm.components import components


def slow_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    counts = [0] * 64
    for sh in shingles:
        h = xxhash.xxh64_intdigest(sh, seed=42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def groups(values, radius):
    root = list(range(len(values)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(values)):
        for b in range(a):
            if bin(values[a] ^ values[b]).count("1") <= radius:
                root[find(a)] = find(b)
    out = {}
    for k, v in enumerate(values):
        out.setdefault(find(k), set()).add(v)
    return {frozenset(g) for g in out.values() if len(g) > 1}


@pytest.mark.parametrize("tile_rows", [s.TILE_ROWS, 6])
def test_links_join_exactly_what_is_reachable(spark, tile_rows):
    rng = random.Random(1)
    values = set()
    for _ in range(25):
        v = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            values.add(v)
            for _ in range(rng.randint(1, 5)):
                v ^= 1 << rng.randrange(64)
    values = sorted(values | {0, 1})
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    prints = spark.createDataFrame(signed, "fp long")
    found = components(s.links(prints, tile_rows=tile_rows)).collect()
    got = {}
    for r in found:
        got.setdefault(r.root, set()).add(r.node & (1 << 64) - 1)
    assert {frozenset(g) for g in got.values()} == groups(values, s.RADIUS)
    assert len(found) == len({r.node for r in found})


def test_fingerprints_and_components(docs):
    long = " ".join(f"w{k % 37}x{k % 11}" for k in range(3000))
    texts = ["A few words here now", "a FEW  words\there now", None, " \n", "", "three word text", long, long, "é ß"]
    got = {r.doc_id: r for r in s.near_duplicates(docs(texts)).collect()}
    assert [got[k].fp & (1 << 64) - 1 for k in range(len(texts))] == [slow_fingerprint(t) for t in texts]
    assert (got[1].component, got[3].component, got[4].component, got[7].component) == (0, 2, 2, 6)
    assert s.near_duplicates(docs([])).count() == 0


def test_spark_hash_agrees(spark):
    h = spark.range(1).select(F.xxhash64(F.lit("a b c d"))).first()[0] & (1 << 64) - 1
    assert h == xxhash.xxh64_intdigest(b"a b c d", seed=42) == s.fingerprint(b"a b c d")


def test_components_of_a_long_chain_and_a_star(spark):
    order = np.random.default_rng(0).permutation(200).tolist()
    chain = list(zip(order, order[1:], strict=False))
    star = [(1000, 1000 + k) for k in range(1, 300)]
    found = components(spark.createDataFrame(chain + star + [(5, 5)], "src long, dst long"))
    roots = {r.node: r.root for r in found.collect()}
    assert roots == {**{k: 0 for k in range(200)}, **{1000 + k: 1000 for k in range(300)}}


def test_clashing_columns_very_long_texts_and_repeated_rows(spark):
    long = "one two three four five " * 200_000
    rows = [(k, t, "a", "b", "c", "d") for k, t in enumerate([long, long + "six", "apart entirely here now"] * 2)] + [(None, long, "a", "b", "c", "d")] * 2
    table = spark.createDataFrame(rows, "doc_id long, text string, fp string, component string, least string, root string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component) for r in s.near_duplicates(table).collect())
    assert got == [(False, 0, 0), (False, 1, 0), (False, 2, 2), (False, 3, 0), (False, 4, 0), (False, 5, 2), (True, 0, 0), (True, 0, 0)]


@pytest.mark.parametrize(("radius", "agreeing"), [(4, 3), (4, 1), (2, 2), (0, 1)])
def test_fingerprints_within_the_radius_share_a_band(radius, agreeing):
    rng = random.Random(3)
    every = s.masks(radius, agreeing)
    for _ in range(200):
        v = rng.getrandbits(64)
        w = v
        for b in rng.sample(range(64), radius):
            w ^= 1 << b
        assert any((v ^ w) & (m & (1 << 64) - 1) == 0 for m in every)
