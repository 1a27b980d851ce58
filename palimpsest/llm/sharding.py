"""Sharding by sampled splitters: shards of near equal bytes, in the order of a content key.

The key is a hash of the text, then the id, then a number of the row, so equal texts lie side by side and a hot group can
still be split. Every row has a chance to be drawn that is proportional to its size; quantiles of the drawn keys are the
splitters, which cut the rows into ranges of near equal bytes. Ranges that turn out overfull are subdivided by keys
drawn from them alone: those of more than OVERFULL times their share, and those that reach over a shard's ideal end by
more than TOLERANCE of a shard. Splitters fall between different texts; only a range of one text is cut inside.

Each range goes whole to the shard that holds its middle byte, so shards begin and end at splitters, and a shard's size is
off by at most TOLERANCE of a shard, or half a row or two where rows are larger. Groups of equal texts of less than that stay together.
A task sorts one range; their number grows with the table, and what the driver holds is a few keys for each.

Edge cases: a null text has no bytes and size 1; a very long text may fill shards alone; rows that repeat, and ties of the
hash, are kept next to each other with slots of their own; a table with fewer rows than shards leaves shards empty; an empty
table gives an empty result; null ids sort first among equal texts; other columns, whatever their names, are ignored by `assign` and
carried on by `write_shards`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from palimpsest.llm.common import cut_lineage

SHARDS = 16
#: Ranges for each shard at least, rows in a range at most on average, and drawn keys for each range.
RANGES = 64
ROWS = 1_000_000
DRAWN = 24
#: A range with more than so many times its share of the bytes is subdivided, into so many ranges.
OVERFULL = 2
PARTS = 16
#: The share of a shard that a range may reach over the shard's ideal end.
TOLERANCE = 0.005
MOST_ROUNDS = 12
KEY = ("key", "tie", "nth")


def _packed(columns: list[np.ndarray]) -> np.ndarray:
    """Keys as byte strings of the same order."""
    flipped = np.stack([c.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63) for c in columns], axis=1)
    return np.ascontiguousarray(flipped.astype(">u8")).view("S24").ravel()


def _drawn(rows: DataFrame, chance: Column, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Range and key of rows drawn with a chance, in key order."""
    dice = F.pmod(F.xxhash64(*KEY, F.lit(salt)), F.lit(1 << 40)) / float(1 << 40)
    found = rows.where(dice < chance).select("range", *KEY).toArrow()
    of, *columns = (c.to_numpy() for c in found.columns)
    keys = np.stack(columns, axis=1).astype(np.int64)
    by = np.lexsort((keys[:, 2], keys[:, 1], keys[:, 0]))
    return of[by], keys[by]


def _quantiles(keys: np.ndarray, parts: int) -> np.ndarray:
    """Splitters between the keys: before a text where there are several, else inside the only one."""
    least = np.iinfo(np.int64).min
    at = np.unique(len(keys) * np.arange(1, parts) // parts) if len(keys) else np.zeros(0, np.int64)
    cut = keys[at]
    if len(keys) and keys[0, 0] != keys[-1, 0]:
        cut = cut.copy()
        cut[:, 1:] = least
        cut = cut[cut[:, 0] != keys[0, 0]]
        if not len(cut):  # the quantiles all fall into the first text
            cut = np.array([[keys[np.argmax(keys[:, 0] != keys[0, 0]), 0], least, least]])
    return np.unique(cut, axis=0)


def _ranged(rows: DataFrame, splitters: np.ndarray) -> DataFrame:
    """`rows` with the number of splitters that are not above the row's key."""
    rows = rows.drop("range")
    schema = StructType([*rows.schema.fields, StructField("range", LongType())])
    sent = rows.sparkSession.sparkContext.broadcast(_packed(list(splitters.T)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _packed([batch.column(c).to_numpy() for c in KEY])
            at = np.searchsorted(sent.value, own, side="right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64())], names=[*batch.schema.names, "range"])

    return rows.mapInArrow(run, schema)


def _sizes(ranged: DataFrame) -> list[tuple[int, int, int]]:
    """(range, bytes, rows) in the order of ranges: a few numbers for each range."""
    found = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).collect()
    return sorted((r["range"], r["bytes"], r["rows"]) for r in found)


def _overfull(sizes: list[tuple[int, int, int]], shards: int, parts: int) -> dict[int, int]:
    """Ranges to subdivide, with their bytes."""
    total = sum(b for _, b, _ in sizes)
    out, end = {}, 0
    for k, b, n in sizes:
        start, end = end, end + b
        over = start * shards // total + 1 <= (end * shards - 1) // total and b * shards > TOLERANCE * total
        if n > 1 and (over or b * parts > OVERFULL * total):
            out[k] = b
    return out


def place(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """`rows` (key, tie, nth, size, ...), of which no two share all three, with range, shard and slot."""
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    parts = max(shards * RANGES, -(-count // ROWS))
    _, keys = _drawn(rows.withColumn("range", F.lit(0)), F.col("size") * (parts * DRAWN / max(1, total)), 0)
    splitters = _quantiles(keys, parts)
    for again in range(1, MOST_ROUNDS + 1):
        ranged = _ranged(rows, splitters)
        sizes = _sizes(ranged)
        over = _overfull(sizes, shards, parts)
        if not over or again == MOST_ROUNDS:
            break
        chances = rows.sparkSession.createDataFrame([(k, PARTS * DRAWN / b) for k, b in over.items()], "range long, chance double")
        of, keys = _drawn(ranged.join(F.broadcast(chances), "range"), F.col("size") * F.col("chance"), again)
        splitters = np.unique(np.concatenate([splitters, *(_quantiles(keys[of == k], PARTS) for k in np.unique(of))]), axis=0)
    starts, done_bytes, done_rows, first = [], 0, 0, {}
    for k, b, n in sizes:
        shard = min(shards - 1, (2 * done_bytes + b) * shards // (2 * total))
        first.setdefault(shard, done_rows)
        starts.append((k, shard, done_rows - first[shard]))
        done_bytes, done_rows = done_bytes + b, done_rows + n
    starts = rows.sparkSession.createDataFrame(starts, "range long, shard int, before long")
    nth = F.row_number().over(Window.partitionBy("range").orderBy(*KEY)) - 1
    return ranged.withColumn("slot", nth).join(F.broadcast(starts), "range").withColumn("slot", F.col("before") + F.col("slot")).drop("before")


def _keyed(docs: DataFrame, id_col: str, text_col: str, *others: Column) -> DataFrame:
    """(others ..., size, key, tie, nth), written, so that the row numbers stay."""
    text = F.col(text_col).cast("string")
    whole = docs.schema[id_col].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    tie = F.col(id_col).cast("long") if whole else F.xxhash64(F.col(id_col))
    rows = docs.select(
        *others,
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.xxhash64(text.isNull(), text).alias("key"),
        F.when(F.col(id_col).isNull(), F.lit(-(1 << 63)).cast("long")).otherwise(tie).alias("tie"),
        F.monotonically_increasing_id().alias("nth"),
    )
    return cut_lineage(rows)


def assign(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot) for every row."""
    crc = F.crc32(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text_crc32")
    rows = _keyed(docs, id_col, text_col, F.col(id_col).alias("id"), crc)
    return place(rows, shards).select(F.col("id").alias(id_col), "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Writes `docs` with a folder for each shard, in files of ascending slots; returns the name of the folders' column.

    That is `shard`, with an underscore more as long as `docs` has such a column.
    """
    name = "shard"
    while name in docs.columns:
        name += "_"
    placed = place(_keyed(docs, id_col, text_col, F.struct(*docs.columns).alias("__row")), shards)
    ordered = placed.repartition("shard", "range").sortWithinPartitions("shard", "slot")
    ordered.select("__row.*", F.col("shard").alias(name)).write.partitionBy(name).parquet(path)
    return name
