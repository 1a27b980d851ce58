"""Exact substring deduplication: suffix arrays over the passages that can repeat.

Every byte inside a 200-byte string that starts anywhere else too is removed. Strings are brought
together by anchors: of the 100-byte grams in a 200-byte window, the one with the smallest hash
(the leftmost of equals) is its anchor. Equal windows have equal anchors at equal distances, so
windows that could be equal meet under one key, wherever they lie. Consecutive windows with the same
anchor make one segment. Grams that anchor one segment only cannot repeat and leave early.

Equal segments of a key are merged with their count, and all of them go to suffix arrays: a task cuts the segments into
8-byte symbols on the grid of their anchor, builds one suffix array over many of them, reads off the runs of suffixes that
share 24 symbols, compares the up to 8 bytes around them, and adds up the counts. What it finds to repeat within a segment
is then cut out of every occurrence of that segment. The merging goes by hashes, so each span carries a digest of
the bytes that the array compared, and is cut only where a text's own bytes have it; any other outcome raises.

A key with more than MOST_SEGMENTS different segments is split by what surrounds the anchor: windows that begin
farther before it share more bytes on that side, others on the other side. Halves are merged and counted anew,
and halved again until they are small or hold windows of one distance only, which are all equal.

Edge cases: a null or empty text has no bytes; texts under 200 bytes lose nothing; a very long text is a block of its
own; a document can repeat within itself; of equally small hashes the leftmost anchors; rows that repeat are documents of
their own, so their text repeats; an empty table gives an empty result; other columns, whatever their names, are carried on or ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import RollingHash, blocks, cut_lineage, row_identity, text_buffer, written
from palimpsest.llm.suffix_array import suffix_array

LENGTH = 200
GRAM = 100
SYMBOL = 8
#: Symbols that every window holds whole, wherever the grid lies.
CORE = (LENGTH - SYMBOL + 1) // SYMBOL
#: Different segments of one key that one task compares.
MOST_SEGMENTS = 4096
#: Symbols in one suffix array; the segments of a key stay together.
ARRAY_SYMBOLS = 100_000

RUNS = "key long, segment long, rid long, place long"
# place: start of the segment << 20 | bytes from there to its anchor << 10 | windows less one


def anchor_runs(data: np.ndarray, offsets: np.ndarray, rolling: RollingHash) -> tuple[np.ndarray, ...]:
    """(row, start, before, windows, key, segment) of each run of windows with the same anchor."""
    n = len(data) - LENGTH + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 6
    rolling.load(data)
    starts = np.arange(len(data) - GRAM + 1)
    grams = rolling.of(starts, starts + GRAM)
    ranked = (grams & np.uint64(0xFFFFFFFF00000000)) | starts.astype(np.uint64)
    wide = LENGTH - GRAM + 1
    rows = np.concatenate([ranked, np.full(-len(ranked) % wide, np.uint64(0xFFFFFFFFFFFFFFFF))]).reshape(-1, wide)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (np.minimum(behind[:n], ahead[wide - 1 : wide - 1 + n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = np.zeros(n + 1, np.int32)  # windows that lie within one text
    long = offsets[1:] - offsets[:-1] >= LENGTH
    np.add.at(inside, offsets[:-1][long], 1)
    np.add.at(inside, offsets[1:][long] - LENGTH + 1, -1)
    inside = np.cumsum(inside)[:n] > 0
    same = np.zeros(n, bool)
    same[1:] = inside[1:] & inside[:-1] & (anchor[1:] == anchor[:-1])
    first = np.flatnonzero(inside & ~same)
    ends = np.flatnonzero(inside & np.concatenate([~same[1:], [True]])) + 1
    anchor = anchor[first]
    row = np.searchsorted(offsets, first, side="right") - 1
    segment = rolling.of(first, ends - 1 + LENGTH) * np.uint64(0x9E3779B97F4A7C15) + (anchor - first).astype(np.uint64)
    return row, first - offsets[row], anchor - first, ends - first, grams[anchor].view(np.int64), segment.view(np.int64)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rolling = RollingHash()
    for block in blocks(batches, 1, 1 << 19):
        row, start, before, windows, key, segment = anchor_runs(*text_buffer(block.column(1)), rolling)
        rid = block.column(0).to_numpy(zero_copy_only=False)[row]
        columns = (key, segment, rid, start << 20 | before << 10 | windows - 1)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["key", "segment", "rid", "place"])


def repeated_windows(segments: list[bytes], before: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each segment: the starts of its windows that occur twice or more in these segments, by their counts.

    Segments that can share a window must be given together; `before` is the distance to the anchor.
    """
    size = np.array([len(s) for s in segments])
    skip = before % SYMBOL
    symbols = (size - skip) // SYMBOL
    data = np.frombuffer(b"".join(segments) + bytes(LENGTH), np.uint8)
    base = np.concatenate([[0], np.cumsum(size)])[:-1]
    owner = np.repeat(np.arange(len(segments)), symbols)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(symbols) - symbols, symbols)
    at = base[owner] + skip[owner] + nth * SYMBOL  # where each symbol starts
    value = np.lib.stride_tricks.sliding_window_view(data, SYMBOL)[at]
    _, code = np.unique(np.ascontiguousarray(value).view(np.uint64).ravel(), return_inverse=True)
    # a separator of its own after each segment, the smallest of all at the very end
    line = np.zeros(len(owner) + len(segments), np.int64)
    where = np.arange(len(owner)) + owner
    line[where] = code + len(segments)
    line[np.cumsum(symbols) + np.arange(len(segments))] = np.arange(len(segments))[::-1]
    order = np.array(suffix_array(line))
    symbol_of = np.full(len(line), -1)
    symbol_of[where] = np.arange(len(owner))
    order = symbol_of[order]
    order = order[order >= 0]
    order = order[nth[order] + CORE <= symbols[owner[order]]]
    cores = np.lib.stride_tricks.sliding_window_view(line, CORE)
    equal = np.zeros(len(order), bool)
    for k in range(1, len(order), 4096):
        own = where[order[k - 1 : k + 4096]]
        equal[k : k + 4096] = (cores[own[1:]] == cores[own[:-1]]).all(axis=1)
    shared = equal | (counts[owner[order]] > 1)
    shared[:-1] |= equal[1:]
    group = np.cumsum(~equal)[shared]
    order = order[shared]
    segment, start = owner[order], at[order]
    edges = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(SYMBOL, np.uint8), data]), SYMBOL)
    left = np.ascontiguousarray(edges[start]).view(">u8").ravel().astype(np.uint64)
    right = np.ascontiguousarray(edges[start + SYMBOL + CORE * SYMBOL]).view(">u8").ravel().astype(np.uint64)
    hit_segment, hit_start = [], []
    for t in range(SYMBOL):
        begin = start - base[segment] - t
        fits = (begin >= 0) & (begin + LENGTH <= size[segment])
        edge = right[fits] >> np.uint64(8 * t)
        if t:
            edge |= left[fits] << np.uint64(64 - 8 * t)
        by = np.lexsort((edge, group[fits]))
        g, e = group[fits][by], edge[by]
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (e[1:] != e[:-1])])[: len(g)]
        which = np.cumsum(new) - 1
        total = np.bincount(which, weights=counts[segment[fits][by]]) if len(g) else np.zeros(0)
        hit = total[which] >= 2
        hit_segment.append(segment[fits][by][hit])
        hit_start.append(begin[fits][by][hit])
    hit_segment, hit_start = np.concatenate(hit_segment), np.concatenate(hit_start)
    by = np.lexsort((hit_start, hit_segment))
    hit_segment, hit_start = hit_segment[by], hit_start[by]
    found, cuts = np.unique(hit_segment, return_index=True)
    for k, starts in zip(found.tolist(), np.split(hit_start, cuts[1:]), strict=True) if len(found) else ():
        yield k, starts


SEGMENTS = "key long, segment long, n long, before int, lo int, hi int, large boolean, bytes binary"
HITS = "key long, segment long, first int, last int, digest long"


def digest(data: bytes) -> int:
    return int.from_bytes(blake2b(data, digest_size=8).digest(), "little", signed=True)


def _hits(rows: list[tuple]) -> list[tuple]:
    """(key, segment, first and last window, digest of their bytes) of each run of repeated windows in rows of SEGMENTS."""
    key, segment, n, before, data = zip(*rows, strict=True)
    out = []
    for k, starts in repeated_windows(list(data), np.array(before), np.array(n)):
        firsts = np.flatnonzero(np.concatenate([[True], starts[1:] > starts[:-1] + 1]))
        lasts = np.concatenate([firsts[1:] - 1, [len(starts) - 1]])
        for a, b in zip(starts[firsts].tolist(), starts[lasts].tolist(), strict=True):
            out.append((key[k], segment[k], a, b, digest(data[k][a : b + LENGTH])))
    return out


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    types = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), types[kind]) for c, kind in zip(columns, kinds, strict=True)], names=list(names))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, segment, n, before, bytes), sorted by key, to HITS."""
    held: list[tuple] = []
    symbols, key = 0, None
    for batch in batches:
        found: list[tuple] = []
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] != key and symbols > ARRAY_SYMBOLS:
                found += _hits(held)
                held.clear()
                symbols = 0
            key = row[0]
            held.append(row)
            symbols += len(row[-1]) // SYMBOL
        yield _batch(found, HITS)
    yield _batch(_hits(held) if held else [], HITS)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, wanted) to SEGMENTS; rows that repeat stand side by side and are read once."""
    before = None
    for batch in batches:
        found: list[tuple] = []
        for text, wanted in zip(batch.column(0), batch.column(1), strict=True):
            rows = wanted.as_py()
            if rows[0]["rid"] == before:
                continue
            before, raw = rows[0]["rid"], (text.as_py() or "").encode()
            for r in rows:
                start, place = r["place"] >> 20, r["place"]
                found.append((r["key"], r["segment"], r["n"], place >> 10 & 1023, 0, LENGTH - GRAM + 1, r["large"], raw[start : start + (place & 1023) + LENGTH]))
        yield _batch(found, SEGMENTS)


PIECES = "key long, segment long, shift int, sub long, piece long, n long, before int, lo int, hi int, bytes binary"


def halves(before: int, lo: int, hi: int, data: bytes) -> Iterator[tuple[int, int, int, int, bytes, bytes]]:
    """(shift, before, lo, hi, bytes, shared bytes) of the windows whose anchor stands at each half of the distances lo to hi - 1."""
    middle = (lo + hi) // 2
    for low, high in ((lo, middle), (middle, hi)):
        first, last = max(0, before - high + 1), min(len(data) - LENGTH, before - low)
        if low < high and first <= last:
            part, anchor = data[first : last + LENGTH], before - first
            yield first, anchor, low, high, part, part[anchor - low : anchor + LENGTH - high + 1]


def _halved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for key, segment, n, before, lo, hi, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for shift, anchor, low, high, part, shared in halves(before, lo, hi, data):
                sub = digest(b"%d,%d,%d," % (key, low, high) + shared)
                found.append((key, segment, shift, sub, digest(b"%d," % anchor + part), n, anchor, low, high, part))
        yield _batch(found, PIECES)


def _by_arrays(segments: DataFrame) -> DataFrame:
    ordered = segments.select("key", "segment", "n", "before", "bytes").repartition("key").sortWithinPartitions("key")
    return ordered.mapInArrow(_compare, HITS)


def _large(segments: DataFrame, most_segments: int) -> DataFrame:
    """(key): keys with more than `most_segments` different segments of more than one distance."""
    return cut_lineage(segments.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most_segments).select("key"))


def _in_halves(segments: DataFrame, most_segments: int) -> DataFrame:
    """HITS of segments of large keys."""
    pieces = cut_lineage(segments.select("key", "segment", "n", "before", "lo", "hi", "bytes").mapInArrow(_halved, PIECES))
    first = [F.first(c).alias(c) for c in ("before", "lo", "hi", "bytes")]
    merged = pieces.groupBy("sub", "piece").agg(F.sum("n").alias("n"), *first).withColumnsRenamed({"sub": "key", "piece": "segment"})
    merged = cut_lineage(merged)
    large = _large(merged.where("hi - lo > 1"), most_segments)
    if large.isEmpty():
        found = _by_arrays(merged)
    else:
        found = _by_arrays(merged.join(large, "key", "left_anti"))
        found = found.unionByName(_in_halves(merged.join(large, "key", "left_semi"), most_segments))
    found = found.withColumnsRenamed({"key": "sub", "segment": "piece"})
    moved = pieces.select("key", "segment", "shift", "sub", "piece").join(found, ["sub", "piece"])
    return moved.selectExpr("key", "segment", "first + shift AS first", "last + shift AS last", "digest")


def spans(rows: DataFrame, most_segments: int = MOST_SEGMENTS) -> DataFrame:
    """(rid, start, end, digest): byte spans of `rows` (__rid, __text, ...) that cover what is to be removed; they may overlap."""
    runs = rows.select("__rid", "__text").mapInArrow(_runs, RUNS)
    keys = runs.groupBy("key").agg(F.count(F.lit(1)).alias("all_runs")).where("all_runs > 1").select("key")
    found = written(runs.join(cut_lineage(keys), "key", "left_semi"), "runs")
    distinct = cut_lineage(found.groupBy("key", "segment").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rid", "place")).alias("at")))
    large = _large(distinct, most_segments)
    none_large = large.isEmpty()
    flagged = distinct.withColumn("large", F.lit(False)) if none_large else distinct.join(large.withColumn("large", F.lit(True)), "key", "left")
    one = F.struct("key", "segment", "n", "at.rid", "at.place", F.coalesce("large", F.lit(False)).alias("large"))
    wanted = flagged.groupBy(F.col("at.rid").alias("__rid")).agg(F.collect_list(one).alias("__wanted"))
    others = [c for c in rows.columns if not c.startswith("__")]  # read with the texts for their last join, so that both shuffle them alike
    segments = rows.join(wanted, "__rid").select("__text", "__wanted", *others).mapInArrow(_cut, SEGMENTS)
    hits = _by_arrays(segments.where("not large"))
    if not none_large:
        hits = hits.unionByName(_in_halves(segments.where("large"), most_segments))
    placed = found.join(hits, ["key", "segment"])  # a segment that occurs very often is split, as both sides come from shuffles
    return placed.selectExpr("rid", "(place >> 20) + first AS start", f"(place >> 20) + last + {LENGTH} AS end", "digest")


def cover(spans: list[dict] | None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs that spans cover; runs that touch are one."""
    if not spans:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pairs = np.array(sorted((s["start"], s["end"]) for s in spans), np.int64)
    reach = np.maximum.accumulate(pairs[:, 1])
    first = np.flatnonzero(np.concatenate([[True], pairs[1:, 0] > reach[:-1]]))
    return pairs[first, 0], reach[np.concatenate([first[1:], [len(pairs)]]) - 1]


def _beside_spans(docs: DataFrame, id_col: str, text_col: str, carried: list[str], most_segments: int) -> DataFrame:
    """(carried ..., __text, __spans): each row of `docs` with the spans to remove.

    Both joins with the texts read the same columns, so the texts are shuffled once.
    """
    rows = docs.select(row_identity(id_col, text_col).alias("__rid"), F.col(text_col).cast("string").alias("__text"), *carried)
    found = spans(rows, most_segments).groupBy(F.col("rid").alias("__rid")).agg(F.collect_set(F.struct("start", "end", "digest")).alias("__spans"))
    return rows.join(found, "__rid", "left").select(*carried, "__text", "__spans")


def _cleaned(block: pa.RecordBatch) -> list[tuple[int, int, int, bytes]]:
    """(bytes, removed bytes, removed runs, kept bytes) of each row of a block that ends in text and spans."""
    out = []
    for text, own in zip(block.column(block.num_columns - 2), block.column(block.num_columns - 1), strict=True):
        raw, found = (text.as_py() or "").encode(), own.as_py() or []
        if any(digest(raw[x["start"] : x["end"]]) != x["digest"] for x in found):
            raise ValueError("segments of different bytes have equal hashes")
        starts, ends = cover(found)
        kept = b"".join(raw[a:b] for a, b in zip([0, *ends.tolist()], [*starts.tolist(), len(raw)], strict=True))
        out.append((len(raw), len(raw) - len(kept), len(starts), kept))
    return out


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_segments: int = MOST_SEGMENTS) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept): kept holds the bytes that stay; every row of `docs` has its row."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, 1):
            n_bytes, n_removed, n_spans, kept = zip(*_cleaned(block), strict=True)
            yield pa.RecordBatch.from_arrays([block.column(0), *(pa.array(c, pa.int64()) for c in (n_bytes, n_removed, n_spans)), pa.array(kept, pa.binary())], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept"])

    joined = _beside_spans(docs, id_col, text_col, [id_col], most_segments)
    return joined.mapInArrow(run, f"`{id_col}` {id_type}, n_bytes long, n_removed long, n_spans long, kept binary")


def strip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_segments: int = MOST_SEGMENTS) -> DataFrame:
    """`docs` with the repeated strings cut out of the texts; a character that a cut splits is dropped.

    A null text stays null; all other columns stay as they are.
    """
    carried = [c for c in docs.columns if c != text_col]
    schema = docs.select(*carried, F.col(text_col).cast("string")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, len(carried)):
            texts = [None if text is None else kept.decode("utf-8", "ignore") for text, (*_, kept) in zip(block.column(len(carried)).to_pylist(), _cleaned(block), strict=True)]
            yield pa.RecordBatch.from_arrays([*block.columns[:-2], pa.array(texts, pa.string())], names=[*carried, text_col])

    joined = _beside_spans(docs, id_col, text_col, carried, most_segments)
    return joined.mapInArrow(run, schema).select(*docs.columns)
