"""SimHash near-duplicates: exact links between fingerprints by tiled comparison.

Fingerprints come from four-word shingles. Equal ones are merged first, so a group of copies is
one fingerprint. The bits are cut into radius + AGREEING pieces: two fingerprints within `radius` bits agree on
at least AGREEING of them, so those that share any AGREEING pieces (a band of some 27 bits) form a tile: rows in order of their
population count, compared by exclusive-or and bit counts in square tiles, of which those whose
population counts differ beyond the radius are skipped. A band value with more than TILE_ROWS
fingerprints is split into cells by population count and hash, and every pair of cells within
the radius is its own unit of work, so no task holds more than two cells.

A task reports the links of a tile as stars (member, smallest member), which keep what is
reachable and never grow with the square of a group.

Edge cases: a null or empty text, or one of spaces only, has fingerprint zero and is linked like
any other; fewer than four words are one shingle; a very long text is hashed in stretches; a bit set in exactly half of the
shingles is 0; null ids are never a component's smallest; rows that repeat share their fingerprint; an empty table gives an
empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import blocks, cut_lineage, text_buffer
from palimpsest.llm.components import components

SHINGLE = 4
SEED = 42
RADIUS = 4
#: Pieces of bits that linked fingerprints agree on at least; more make narrower tiles, and more of them.
AGREEING = 3
#: Fingerprints of one band value that a single task compares.
TILE_ROWS = 4096
#: Side of the square tiles inside a task.
SIDE = 512

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash of a text's word shingles; zero without words."""
    joined = b" ".join(text.translate(LOWER).split())
    if not joined:
        return 0
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(spaces + 1).tolist()]
    ends = [*spaces.tolist(), len(joined)]
    ends = ends[shingle - 1 :] or ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends, strict=False)], ">u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): fp as a signed 64-bit number."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, 1):
            data, offsets = text_buffer(block.column(1))
            raw, offsets = data.tobytes(), offsets.tolist()
            found = [fingerprint(raw[a:b], shingle) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], names=[id_col, "fp"])

    return docs.select(id_col, F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"`{id_col}` {id_type}, fp long")


def stars(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, smallest member) of every group of linked fingerprints, without the smallest itself."""
    bits = np.bitwise_count(values.view(np.uint64)).astype(np.int16)
    by = np.argsort(bits, kind="stable")
    values, bits = values[by].view(np.uint64), bits[by]
    n = len(values)
    found = []
    for i in range(0, n, SIDE):
        for j in range(i, n, SIDE):
            if bits[j] - bits[min(i + SIDE, n) - 1] > radius:
                break  # the tiles after it are further still
            near = np.bitwise_count(values[i : i + SIDE, None] ^ values[None, j : j + SIDE]) <= radius
            if i == j:
                near = np.triu(near, 1)
            a, b = np.nonzero(near)
            if len(a):
                found.append(_forest(a + i, b + j, n))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    label = np.arange(n)
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    label = _labels(a, b, n)
    signed = values.view(np.int64)
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, label, signed)
    root = least[label]
    member = root != signed
    return signed[member], root[member]


def _labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest index reachable by links a-b from each index."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The links of one tile, as stars on local indexes: as few as it has members."""
    used, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = _labels(at[: len(a)], at[len(a) :], len(used))
    out = label != np.arange(len(used))
    return used[out], used[label[out]]


def _star_batch(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    src, dst = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 2
    return pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], names=["src", "dst"])


def masks(radius: int, agreeing: int = AGREEING) -> list[int]:
    """The bits of each band, as signed numbers: every choice of `agreeing` of the pieces."""
    pieces = radius + agreeing
    edges = [64 * k // pieces for k in range(pieces + 1)]
    bits = [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:], strict=False)]
    chosen = [sum(own) for own in combinations(bits, agreeing)]
    return [m - (1 << 64) if m >> 63 else m for m in chosen]


def links(prints: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(src, dst): stars that join exactly the distinct fingerprints `fp` reachable by steps within the radius."""
    keys = [F.struct(F.lit(k).alias("band"), F.col("fp").bitwiseAND(F.lit(mask)).alias("value")) for k, mask in enumerate(masks(radius))]
    rows = prints.select("fp", F.bit_count("fp").alias("bits"), F.explode(F.array(*keys)).alias("key")).select("key.band", "key.value", "bits", "fp")
    cells = rows.groupBy("band", "value", "bits").agg(F.count(F.lit(1)).alias("n"))
    large = cells.groupBy("band", "value").agg(F.sum("n").alias("all_rows")).where(F.col("all_rows") > tile_rows)
    large = cut_lineage(large.select("band", "value"))
    none_large = large.isEmpty()
    small = rows if none_large else rows.join(large, ["band", "value"], "left_anti")

    def settle(held: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        return [stars(np.concatenate(held), radius)] if sum(map(len, held)) > 1 else []

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # of the band value that is being read
        key = None
        for batch in batches:
            band, value, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(fp):
                continue
            cuts = (np.flatnonzero((band[1:] != band[:-1]) | (value[1:] != value[:-1])) + 1).tolist()
            found = []
            for a, b in zip([0, *cuts], [*cuts, len(fp)], strict=True):
                if key != (band[a], value[a]):
                    found += settle(held)
                    held, key = [], (band[a], value[a])
                held.append(fp[a:b])
            yield _star_batch(found)
        yield _star_batch(settle(held))

    found = small.select("band", "value", "fp").repartition("band", "value").sortWithinPartitions("band", "value").mapInArrow(compare, "src long, dst long")
    if none_large:
        return found
    return found.unionByName(_across_cells(rows, cells, large, radius, tile_rows))


def _across_cells(rows: DataFrame, cells: DataFrame, large: DataFrame, radius: int, tile_rows: int) -> DataFrame:
    """The links of band values with more than `tile_rows` fingerprints, a pair of cells at a time."""
    cells = cells.join(large, ["band", "value"], "left_semi").select("band", "value", "bits", F.ceil(F.col("n") * 2 / tile_rows).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("parts")).cast("int")
    split = rows.join(cells, ["band", "value", "bits"]).withColumn("part", part)
    packed = split.groupBy("band", "value", "bits", "part").agg(F.collect_list("fp").alias("fps"))  # about tile_rows / 2 at most, by the hash
    packed = cut_lineage(packed.withColumn("cell", F.xxhash64("band", "value", "bits", "part")))
    left = packed.select("band", "value", F.col("bits").alias("bits_a"), F.col("cell").alias("cell_a"))
    right = packed.select("band", "value", F.col("bits").alias("bits_b"), F.col("cell").alias("cell_b"))
    near = F.expr(f"bits_b between bits_a and bits_a + {radius} and (bits_b > bits_a or cell_b >= cell_a)")
    pairs = left.join(right, ["band", "value"]).where(near).select("cell_a", "cell_b")
    both = pairs.join(packed.select(F.col("cell").alias("cell_a"), F.col("fps").alias("a")), "cell_a").join(packed.select(F.col("cell").alias("cell_b"), F.col("fps").alias("b")), "cell_b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                a, b = (batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in (0, 1))
                yield _star_batch([stars(np.unique(np.concatenate([a, b])), radius)])

    return both.select("a", "b").mapInArrow(compare, "src long, dst long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(id, fp, component): component is the smallest id reachable by fingerprints within the radius."""
    prints = cut_lineage(fingerprints(docs, id_col, text_col, shingle))
    distinct = cut_lineage(prints.groupBy("fp").agg(F.min(id_col).alias("least")))
    roots = components(links(distinct, radius, tile_rows)).select(F.col("node").alias("fp"), "root")
    grouped = distinct.join(roots, "fp")
    joined = grouped.select("fp", "root").join(grouped.groupBy("root").agg(F.min("least").alias("component")), "root").select("fp", "component")
    known = distinct.join(joined, "fp", "left").select("fp", F.coalesce("component", "least").alias("component"))
    return prints.join(known, "fp", "left").select(id_col, "fp", "component")
