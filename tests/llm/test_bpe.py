from __future__ import annotations

import hashlib
import struct

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import bpe

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
PEER = tiktoken.Encoding("peer", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
REPLAY = bpe.MergeReplay(RANKS)
CUT = bpe.piece_cutter(public_tokenizers.PATTERN)


def ids(text):
    found = b"".join(REPLAY.encode([piece.encode() for piece in CUT(text)]))
    return [i for (i,) in struct.iter_unpack("<I", found)]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80) | st.text(alphabet="abehnortu  '\n", max_size=120))
def test_same_ids_as_the_library(text):
    text = text.encode("utf-8", "ignore").decode()
    assert ids(text) == PEER.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 3001, "ab" * 900, " " * 500, "é" * 700, " \x1c\x85 x", "😀" * 40 + " ok"])
def test_long_and_odd_pieces(text):
    assert ids(text) == PEER.encode_ordinary(text)


def test_encode_decode_over_a_table(docs):
    texts = ["Hello world, hello!", None, "", "x" * 2000, "Hello world, hello!", "naïve 1234\n\n  end"]
    got = {r.doc_id: r for r in bpe.round_trip(docs(texts), RANKS, public_tokenizers.PATTERN).collect()}
    apart = {r.doc_id: r for r in bpe.decode(bpe.encode(docs(texts), RANKS, public_tokenizers.PATTERN), RANKS).collect()}
    for k, text in enumerate(texts):
        want = PEER.encode_ordinary(text or "")
        assert got[k].n_tokens == len(want)
        assert got[k].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
        assert apart[k].decoded == (text or "").encode() and hashlib.sha256(apart[k].ids).hexdigest() == got[k].ids_sha256
    assert bpe.round_trip(docs([]), RANKS, public_tokenizers.PATTERN).count() == 0
    assert bpe.encode(docs([]), RANKS, public_tokenizers.PATTERN).count() == 0


def test_forgotten_pieces_are_encoded_anew(docs, monkeypatch):
    texts = [" ".join(f"w{k * j}" for j in range(50)) for k in range(40)]
    want = {r.doc_id: r.ids_sha256 for r in bpe.round_trip(docs(texts), RANKS, public_tokenizers.PATTERN).collect()}
    monkeypatch.setattr(bpe, "REMEMBERED_BYTES", 100)
    codec = bpe.Codec(REPLAY, public_tokenizers.PATTERN)
    got = [codec.encode(pa.array([t]))[0] for t in texts]
    assert {k: hashlib.sha256(ids).hexdigest() for k, ids in enumerate(got)} == want


def test_clashing_columns_and_very_long_text(spark):
    table = spark.createDataFrame([(1, "word " * 400_000, "x", "y", "z")], "doc_id long, text string, ids string, decoded string, __text string")
    row = bpe.round_trip(table, RANKS, public_tokenizers.PATTERN).first()
    assert row.n_tokens == len(PEER.encode_ordinary("word " * 400_000))
