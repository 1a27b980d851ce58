"""Streams of versions as snapshots and patches, and what they hold again.

A patch is the new version compressed against the one before as its dictionary. Chains are short, at most
MOST_PATCHES patches on a snapshot, and a chain lies in one task: storing and replaying are linear in its versions, and
a long stream is spread over many tasks. Places along a stream are settled without the payloads.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import labels
from palimpsest.operators import store

#: Smaller versions are stored whole.
LEAST_PATCHED = 64 << 10
LEVEL = 3
#: Bytes that a task makes before it hands them on.
BATCH_BYTES = 16 << 20


def patch(base: bytes, new: bytes) -> bytes:
    """`new` as a patch on `base`."""
    window = min(27, max(10, (len(base) + len(new)).bit_length()))
    settings = zstandard.ZstdCompressionParameters.from_level(LEVEL, window_log=window, enable_ldm=True)
    return zstandard.ZstdCompressor(dict_data=_dictionary(base), compression_params=settings).compress(new)


def patched(base: bytes, data: bytes) -> bytes:
    """What `patch` was given."""
    return zstandard.ZstdDecompressor(dict_data=_dictionary(base), max_window_size=1 << 27).decompress(data)


def _dictionary(base: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(base, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


STORED = "stream string, seq long, content string, base string, chain long, chain_len int, object string, size long, data binary"


def eligible(payload: Column, least: int = LEAST_PATCHED) -> Column:
    """Whether a version may be a patch: long enough, and not packed already."""
    return (F.octet_length(payload) >= least) & ~labels.compressed(payload)


def stored(versions: DataFrame, least: int = LEAST_PATCHED, most: int = store.MOST_PATCHES) -> DataFrame:
    """STORED of versions (stream, seq, payload): contents that a stream has already are not stored again.

    `chain` is the seq of the snapshot that a version rests on. An object is a zstd snapshot, or a patch on `base`.
    `versions` is read twice: for the places, which are narrow rows, and for the payloads, which go to their chains.
    """
    hashed = versions.select("stream", "seq", F.sha2("payload", 256).alias("content"), "payload")
    first = store.distinct_versions(hashed.select("stream", "seq", "content", eligible(F.col("payload"), least).alias("__may")))
    lengths = store.chain_lengths(first, F.col("__may"), most=most)
    along = Window.partitionBy("stream").orderBy("seq")
    chain = F.last(F.when(F.col("chain_len") == 0, F.col("seq")), ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0))
    places = lengths.select("stream", "seq", "content", chain.cast("long").alias("chain"), "chain_len")
    payloads = hashed.select(F.col("stream").alias("__stream"), F.col("seq").alias("__seq"), F.col("content").alias("__content"), "payload")
    own = F.col("stream").eqNullSafe(F.col("__stream")) & (F.col("seq") == F.col("__seq")) & (F.col("content") == F.col("__content"))
    whole = places.join(payloads, own, "left").select("stream", F.col("seq").cast("long").alias("seq"), "content", "chain", "chain_len", "payload")
    made = _along_chains(whole).mapInArrow(_store, _MADE)
    return made.select("stream", "seq", "content", "base", "chain", "chain_len", labels.object_name(F.col("content"), F.col("base")).alias("object"), "size", "data")


_MADE = "stream string, seq long, content string, base string, chain long, chain_len int, size long, data binary"
_MADE_TYPES = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
_REPLAYED = "stream string, seq long, content string, chain long, chain_len int, payload binary"
_REPLAYED_TYPES = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.binary()]


def _along_chains(rows: DataFrame) -> DataFrame:
    """`rows` with each chain in one task, in its order."""
    return rows.repartition("stream", "chain").sortWithinPartitions("stream", "chain", "chain_len", "content")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns), strict=True)


def _batches(rows: Iterator[tuple], types: list[pa.DataType], names: str) -> Iterator[pa.RecordBatch]:
    """Batches of rows whose last value is bytes, of about BATCH_BYTES each."""
    columns = [c.split()[0] for c in names.split(", ")]
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in zip(zip(*held, strict=True), types, strict=True)], columns)

    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size >= BATCH_BYTES or len(held) == 10_000:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Versions chain by chain; what is held is the one before."""

    def run() -> Iterator[tuple]:
        whole = zstandard.ZstdCompressor(LEVEL)
        last, before = None, None
        for stream, seq, content, chain, depth, payload in _rows(batches):
            if payload is None:
                raise ValueError(f"version {seq} of {stream} has no payload, or another one when it is read again")
            if (stream, seq, content) == last:
                continue  # handed in twice
            data = whole.compress(payload) if depth == 0 or not before else patch(before, payload)
            yield stream, seq, content, last[2] if depth else None, chain, depth, len(data), data
            last, before = (stream, seq, content), payload

    return _batches(run(), _MADE_TYPES, _MADE)


def replayed(found: DataFrame) -> DataFrame:
    """(stream, seq, content, chain, chain_len, payload) of all versions of STORED; a version whose bytes are not its content raises."""
    return _along_chains(found.select("stream", "seq", "content", "chain", "chain_len", "data")).mapInArrow(_replay, _REPLAYED)


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def run() -> Iterator[tuple]:
        whole = zstandard.ZstdDecompressor()
        own, before = None, None
        for stream, seq, content, chain, depth, data in _rows(batches):
            if (stream, chain) != own:
                own, before = (stream, chain), None
            before = whole.decompress(data) if depth == 0 or not before else patched(before, data)
            if hashlib.sha256(before).hexdigest() != content:
                raise ValueError(f"{content} does not come back from its chain")
            yield stream, seq, content, chain, depth, before

    return _batches(run(), _REPLAYED_TYPES, _REPLAYED)


def reconstructed(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """`replayed` of the wanted (stream, content) only: their chains up to the last wanted version of each."""
    last = found.join(wanted.distinct(), ["stream", "content"], "left_semi").groupBy("stream", "chain").agg(F.max("seq").alias("__last"))
    needed = found.join(last, ["stream", "chain"]).where("seq <= __last").drop("__last")
    return replayed(needed).join(wanted.distinct(), ["stream", "content"], "left_semi")


# ---- chains and packs as tables


SHARDS = 256


def _shard(stream: Column) -> Column:
    """Streams of one tracked file lie in one shard."""
    return F.pmod(F.xxhash64(labels.shard_of(stream)), F.lit(SHARDS)).cast("int")


def write_chains(found: DataFrame, path: str) -> None:
    """Writes chains by shard; of a table that is there, only the shards that `found` has rows of are replaced."""
    rows = found.withColumn("shard", _shard(F.col("stream"))).repartition("shard")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)


def read_chains(spark: SparkSession, path: str, streams: list[str] | None = None) -> DataFrame:
    """All chains, or those of some streams, whose shards alone are read."""
    found = spark.read.parquet(path)
    if streams is not None:
        wanted = spark.createDataFrame([(s,) for s in streams], "stream string").select(_shard(F.col("stream")).alias("s")).distinct().collect()
        found = found.where(F.col("shard").isin([r["s"] for r in wanted]) & F.col("stream").isin(streams))
    return found.drop("shard")


def all_chains(on_disk: DataFrame, unsaved: DataFrame) -> DataFrame:
    """Chains of both sides; a stream that is unsaved counts as it stands there."""
    return on_disk.join(unsaved.select("stream").distinct(), "stream", "left_anti").unionByName(unsaved)


def write_packs(objects: DataFrame, path: str, pack_bytes: int = 64 << 20) -> None:
    """Appends new objects (object, size, data) as packs of about `pack_bytes`, each sorted by name."""
    total = objects.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    objects.repartitionByRange(max(1, -(-total // pack_bytes)), "object").sortWithinPartitions("object").write.mode("append").parquet(path)


def pack_index(spark: SparkSession, path: str) -> DataFrame:
    """(pack, object, size) without reading what the objects hold; a pack that cannot be read is passed over."""
    packs = spark.read.schema("object string, size long, data binary").option("ignoreCorruptFiles", "true").parquet(path)
    return packs.select(F.input_file_name().alias("pack"), "object", "size")
