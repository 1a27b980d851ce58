"""What the operators share: Arrow text access, row identity and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task works on at once; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one is made only where none is set and all runs on one machine, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """`df` written to the shared checkpoint folder, so that lost executors cost no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """`df` written as a Parquet table in the shared folder and read again, and where it lies."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    return written_at(df, name)[0]


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a table that `written_at` made, in whatever store it lies."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def row_identity(id_col: str, text_col: str) -> Column:
    """A 64-bit identity of (id, text): rows that repeat both share it, so joins on it never multiply rows."""
    return F.xxhash64(F.col(id_col).isNull(), F.col(id_col).cast("string"), F.col(text_col).isNull(), F.col(text_col))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and n + 1 offsets into them; null is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batches: Iterator[pa.RecordBatch], text: int, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows again, in batches of about `limit` bytes of the column with index `text`."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_buffer(batch.column(text))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def mix64(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over the whole range, one to one."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class RollingHash:
    """64-bit polynomial hashes of any substrings of a buffer, from prefix sums (modulo 2 to the 64th)."""

    BASE = 0x9E3779B97F4A7C15
    INVERSE = pow(BASE, -1, 1 << 64)

    def __init__(self) -> None:
        self.letters = mix64(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)
        self.up = self.down = np.ones(1, np.uint64)

    def load(self, data: np.ndarray) -> None:
        n = len(data)
        if len(self.up) < n + 1:
            size = max(n + 1, 1 << 16)
            self.up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, self.BASE, np.uint64)]))
            self.down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, self.INVERSE, np.uint64)]))
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(self.letters[data] * self.up[:n], out=self.prefix[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix64((self.prefix[ends] - self.prefix[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def separated(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts with a space after each, and n + 1 offsets that count those spaces in."""
    data, offsets = text_buffer(texts)
    n = len(offsets) - 1
    starts = offsets + np.arange(n + 1)
    out = np.full(len(data) + n, 32, np.uint8)
    inside = np.ones(len(out), bool)
    inside[starts[1:] - 1] = False
    out[inside] = data
    return out, starts


def word_bounds(is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of word bytes; the last byte must not be one."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], is_word]).view(np.int8)))
    return edge[::2], edge[1::2]
