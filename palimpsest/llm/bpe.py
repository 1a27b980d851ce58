"""Byte-level BPE: encoding by corpus-level merge replay, and decoding.

A task cuts its texts into pieces by the tokenizer's pattern, gathers the distinct pieces of a
block, and replays the merges over all of them at once: an inverted index leads from the token
that a pair makes to the positions of that pair, the lowest rank goes first, and a merge looks
only at the two neighbours it touches. Texts are then read off piece by piece.

The tables that follow from the ranks are made once on the driver and broadcast: their size is that of a
vocabulary file, not of the data. A task works on REPLAYED_BYTES of text at a time and remembers
pieces of at most REMEMBERED_BYTES.

Edge cases: a null or empty text has no ids; a very long text is a block of its own, and one of a single
long piece costs n log n; there are no ties, since ranks differ and the leftmost place of a rank goes first; rows
that repeat are encoded alike; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Callable, Iterator
from functools import cache
from hashlib import sha256
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import blocks

#: Bytes of text whose distinct pieces are replayed together.
REPLAYED_BYTES = 2 << 20
#: Bytes of pieces that a task remembers between blocks; beyond it the memory starts anew. A piece costs PIECE_BYTES besides its own.
REMEMBERED_BYTES = 24 << 20
PIECE_BYTES = 250


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary file: one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class MergeReplay:
    """Replays the merges of a rank table over many pieces at once."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.keys = np.array(sorted(pairs), np.int64)
        self.made = np.array([pairs[k] for k in self.keys.tolist()], np.int32)

    def _makes(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The tokens that pairs make, or -1."""
        pair = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where(self.keys[at] == pair, self.made[at], np.int32(-1))

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, as little-endian unsigned 32-bit integers."""
        out = [None if (known := self.ranks.get(piece)) is None else known.to_bytes(4, "little") for piece in pieces]
        rest = [k for k, found in enumerate(out) if found is None]
        if not rest:
            return out
        data = np.frombuffer(b"".join(pieces[k] for k in rest), np.uint8)
        ends = np.cumsum([len(pieces[k]) for k in rest])
        token, alive, odd = self._replay(data, ends)
        counts = np.concatenate([[0], np.cumsum(alive)])[np.concatenate([[0], ends])] * 4
        ids = token[alive].astype("<u4").tobytes()
        for k, start, end in zip(rest, counts[:-1].tolist(), counts[1:].tolist(), strict=True):
            out[k] = ids[start:end]
        for k in np.unique(np.searchsorted(ends, odd, side="right")).tolist():
            out[rest[k]] = np.array(self._in_turn(pieces[rest[k]]), "<u4").tobytes()
        return out

    def decode(self, ids: bytes | None) -> bytes:
        """The bytes that ids stand for."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids or b"", "<u4").tolist()))

    def _replay(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens by position, which positions still start one, and positions in pieces whose ranks fell.

        Pieces do not touch, so all positions of one rank merge together. That is the order
        of a piece by itself as long as no merge makes a pair of lower rank than its own;
        pieces in which one does are named, for the caller to replay in turn.
        """
        n = len(data)
        token = self.single[data]
        alive = np.ones(n, bool)
        after = np.arange(1, n + 1)
        before = np.arange(-1, n - 1)
        after[ends[ends > 0] - 1] = -1
        before[ends[:-1][ends[:-1] < n]] = -1
        makes = np.full(n, -1, np.int32)
        inner = np.flatnonzero(after >= 0)
        makes[inner] = self._makes(token[inner], token[inner + 1])
        index: dict[int, list[np.ndarray]] = {}
        order: list[int] = []

        def note(made: np.ndarray, places: np.ndarray) -> None:
            by = np.argsort(made, kind="stable")
            made, places = made[by], places[by]
            firsts = np.flatnonzero(np.concatenate([[True], made[1:] != made[:-1]]))
            for m, a, b in zip(made[firsts].tolist(), firsts.tolist(), [*firsts[1:].tolist(), len(made)], strict=True):
                if m in index:
                    index[m].append(places[a:b])
                else:
                    index[m] = [places[a:b]]
                    heapq.heappush(order, m)

        first = inner[makes[inner] >= 0]
        if len(first):
            note(makes[first], first)
        odd = [np.zeros(0, np.int64)]
        while order:
            rank = heapq.heappop(order)
            places = index.pop(rank)
            at = np.unique(np.concatenate(places))
            at = at[makes[at] == rank]
            if not len(at):
                continue
            gone = after[at]
            if len(at) > 1 and (touching := at[1:] == gone[:-1]).any():
                runs = np.flatnonzero(np.concatenate([[True], ~touching]))  # of pairs that share a token: every other one merges
                nth = np.arange(len(at)) - np.repeat(runs, np.diff(np.concatenate([runs, [len(at)]])))
                at, gone = at[nth % 2 == 0], gone[nth % 2 == 0]
            then = after[gone]
            if len(at) > 1 and (next_to := then[:-1] == at[1:]).any():  # for a moment, the left one stood before an unmerged token
                beside = at[:-1][next_to]
                passing = self._makes(np.full(len(beside), rank, np.int32), token[then[:-1][next_to]])
                odd.append(beside[(passing >= 0) & (passing < rank)])
            token[at] = rank
            after[at] = then
            alive[gone] = False
            makes[gone] = -1
            makes[at] = -1
            on = then >= 0
            before[then[on]] = at[on]
            behind = before[at]
            left = np.concatenate([at[on], behind[behind >= 0]])
            if not len(left):
                continue
            made = self._makes(token[left], token[after[left]])
            makes[left] = made
            if (fell := (made >= 0) & (made < rank)).any():
                odd.append(left[fell])
            if (rose := made > rank).any():
                note(made[rose], left[rose])
        return token, alive, np.concatenate(odd)

    def _in_turn(self, piece: bytes) -> list[int]:
        """One piece, a merge at a time: the lowest rank first, the leftmost of its places first."""
        token = self.single[np.frombuffer(piece, np.uint8)].tolist()
        n = len(token)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]

        def makes(left: int, right: int) -> int:
            return self.ranks.get(self.tokens[left] + self.tokens[right], -1)

        queue = [(made, i) for i in range(n - 1) if (made := makes(token[i], token[i + 1])) >= 0]
        heapq.heapify(queue)
        while queue:
            made, i = heapq.heappop(queue)
            j = after[i]
            if j < 0 or token[i] < 0 or makes(token[i], token[j]) != made:
                continue
            token[i], token[j] = made, -1
            after[i], after[j] = after[j], -1
            if after[i] >= 0:
                before[after[i]] = i
            for a in (i, before[i]):
                if a >= 0 and after[a] >= 0 and (new := makes(token[a], token[after[a]])) >= 0:
                    heapq.heappush(queue, (new, a))
        return [t for t in token if t >= 0]


@cache
def piece_cutter(pattern: str) -> Callable[[str], list[str]]:
    """Finds the matches of a pattern in a text.

    The letter, number and space classes of the pattern are spelled out for the standard
    library's quicker engine; texts with characters beyond the basic plane use the pattern itself.
    """
    every = "".join(chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000)

    def ranges(kind: str) -> str:
        return "".join(f"{re.escape(m[0][0])}-{re.escape(m[0][-1])}" for m in regex.finditer(f"{kind}+", every))

    letters, numbers, spaces = ranges(r"\p{L}"), ranges(r"\p{N}"), ranges(r"\s")
    plain = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{spaces}{letters}{numbers}]")
    for kind, spelled in ((r"\p{L}", f"[{letters}]"), (r"\p{N}", f"[{numbers}]"), (r"\s", f"[{spaces}]"), (r"\S", f"[^{spaces}]")):
        plain = plain.replace(kind, spelled)
    quick, full = re.compile(plain).findall, regex.compile(pattern).findall
    beyond = re.compile("[\U00010000-\U0010ffff]").search
    return lambda text: full(text) if beyond(text) else quick(text)


class _Numbering(dict):
    """Numbers pieces from 0 on, in the order in which they turn up."""

    def __missing__(self, piece: str) -> int:
        self[piece] = new = len(self)
        return new


class Codec:
    """Encodes the texts of a task block by block."""

    def __init__(self, replay: MergeReplay, pattern: str) -> None:
        self.replay, self.cut = replay, piece_cutter(pattern)
        self.number = _Numbering()
        self.known: list[bytes] = []
        self.held = 0

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        if self.held > REMEMBERED_BYTES:
            self.number.clear()
            self.known.clear()
            self.held = 0
        pieces = [np.fromiter(map(self.number.__getitem__, self.cut(text.as_py() or "")), np.uint32) for text in texts]
        new = [piece.encode() for piece in islice(self.number, len(self.known), None)]
        self.known += self.replay.encode(new)
        self.held += sum(map(len, new)) + PIECE_BYTES * len(new)
        return [b"".join(map(self.known.__getitem__, own.tolist())) for own in pieces]


def _sent(df: DataFrame, ranks: dict[bytes, int]) -> Broadcast:
    return df.sparkSession.sparkContext.broadcast(MergeReplay(ranks))


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the token ids of every whole text, as little-endian unsigned 32-bit integers."""
    id_type, sent = docs.schema[id_col].dataType.simpleString(), _sent(docs, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(sent.value, pattern)
        for block in blocks(batches, 1, REPLAYED_BYTES):
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(codec.encode(block.column(1)), pa.binary())], names=[id_col, "ids"])

    return docs.select(id_col, F.col(text_col).cast("string").alias("__text")).mapInArrow(run, f"`{id_col}` {id_type}, ids binary")


def decode(encoded: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id") -> DataFrame:
    """(id, ids, decoded): the bytes that the ids stand for; null ids decode to no bytes."""
    id_type, sent = encoded.schema[id_col].dataType.simpleString(), _sent(encoded, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [sent.value.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=[id_col, "ids", "decoded"])

    return encoded.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {id_type}, ids binary, decoded binary")


def round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every whole text: encoded and decoded in one task, so that only digests leave it."""
    id_type, sent = docs.schema[id_col].dataType.simpleString(), _sent(docs, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(sent.value, pattern)
        for block in blocks(batches, 1, REPLAYED_BYTES):
            ids = codec.encode(block.column(1))
            counts = pa.array([len(own) // 4 for own in ids], pa.int64())
            digests = [pa.array([sha256(b).hexdigest() for b in found], pa.string()) for found in (ids, map(sent.value.decode, ids))]
            yield pa.RecordBatch.from_arrays([block.column(0), counts, *digests], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = f"`{id_col}` {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(id_col, F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)
