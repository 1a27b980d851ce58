from __future__ import annotations

import hashlib
import random
from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.llm import suffix_dedup as s
from palimpsest.llm.suffix_array import suffix_array


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60))
def test_suffix_array(text):
    text = [*text, 0]
    assert suffix_array(text) == sorted(range(len(text)), key=lambda k: text[k:])


def brute(texts):
    raw = [(t or "").encode() for t in texts]
    times = Counter(b[k : k + 200] for b in raw for k in range(len(b) - 199))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - 199):
            if times[b[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        runs = sum(g and not p for g, p in zip(gone, b"\0" + bytes(gone), strict=False))
        out.append((len(b), len(b) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return out


def cases():
    rng = random.Random(5)
    a = "".join(rng.choice("abcdef ") for _ in range(4000))
    near = [a[:600] + rng.choice("xyz") + a[600 + k : 1400] for k in range(6)]
    return [a[:1000], a[500:1700], a[10:209], a[10:210], "a" * 500, "a" * 250, "é" * 300, None, "", a[700:950] + "é" * 99 + a[:260], "ab" * 200, a[3000:3400] + "x" + a[3000:3400], a[3000:3199], a[:1000], *near]


@pytest.mark.parametrize("most_segments", [s.MOST_SEGMENTS, 1, 3])
def test_matches_brute_force(docs, most_segments):
    texts = cases()
    table = docs(texts, ids=[None if k == 3 else k // 2 for k in range(len(texts))])
    got = Counter(tuple(r) for r in s.deduplicate(table, most_segments=most_segments).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect())
    assert got == Counter((None if k == 3 else k // 2, *w) for k, w in enumerate(brute(texts)))


def test_strip_keeps_columns_and_rows(docs):
    texts = ["unique words only", "p" * 10 + "q" * 300, None, "r" * 5 + "q" * 300]
    table = docs(texts)
    got = {r.doc_id: r for r in s.strip(table).collect()}
    assert s.strip(table).columns == table.columns
    assert [got[k].text for k in range(4)] == ["unique words only", "p" * 10, None, "r" * 5] and got[1].spans == "clash"
    assert s.strip(docs([])).count() == 0


def test_very_long_texts_repeated_rows_and_clashing_columns(spark):
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefgh ") for _ in range(1_500_000))
    rows = [(1, long, "a", "b"), (2, "x" * 50 + long[700_000:700_300], "a", "b")] + [(3, long[:250] + "same row", "a", "b")] * 40 + [(None, None, "a", "b")] * 2
    table = spark.createDataFrame(rows, "doc_id long, text string, digest string, key string")
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in s.deduplicate(table).collect())
    assert got == Counter({(1, 1_500_000, 550, 2): 1, (2, 350, 300, 1): 1, (3, 258, 258, 1): 40, (None, 0, 0, 0): 2})
    assert s.strip(table).columns == table.columns


def test_a_cut_whose_bytes_differ_raises(docs):
    table = docs(["p" * 300, "q" * 300])
    block = pa.RecordBatch.from_arrays([pa.array(["z" * 300]), pa.array([[{"start": 0, "end": 200, "digest": 1}]])], names=["text", "spans"])
    with pytest.raises(ValueError, match="equal hashes"):
        s._cleaned(block)
    assert s.deduplicate(table).count() == 2
