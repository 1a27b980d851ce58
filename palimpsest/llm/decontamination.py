"""Benchmark decontamination: Wu-Manber search for the word windows of all test items at once.

Words are the symbols. For each window length there is a shift table over blocks of two words:
a block that ends no window, or ends one only further left, lets the search skip ahead; a
block that ends a window leads to the bucket of windows with that last block, whose words are
compared directly. A task walks many stretches of its texts side by side.

A benchmark of at most ITEM_BYTES of text goes to every task as one matcher, and nothing is shuffled. Of a larger one only the
shift tables do, whose size is fixed: Spark makes them, as it makes the windows. A task then gives the places where a shift
table lets no skip, with the hash of the window there; a join on that hash is the bucket, and the words of what it
finds are compared where the text lies. Both ways give the same rows.

Edge cases: a null or empty text has no words and no hits; a very long text is a block of its own; an item without words has
no window; an item of fewer words than a window is one window; items that repeat an id are one item; a null
item id counts as the empty id; windows that several items share count for each; rows that repeat are searched alike; empty
tables give no hits or no rows; other columns, whatever their names, are ignored or carried on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import RollingHash, blocks, cut_lineage, mix64, separated, word_bounds

WINDOW = 10
ITEM_BYTES = 4 << 20
TABLE_BITS = 18
#: Stretches that a task walks side by side.
LANES = 2048

#: A-Z lower-cased; ASCII characters that are neither letters nor digits become spaces.
FOLDED = np.array([b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256)], np.uint8)


class Words:
    """The words of many texts: where each starts and ends, its text, and a 64-bit hash."""

    def __init__(self, texts: pa.Array, rolling: RollingHash) -> None:
        data, self.offsets = separated(texts)
        self.data = FOLDED[data]
        self.starts, self.ends = word_bounds(self.data != 32)
        rolling.load(self.data)
        self.hashes = rolling.of(self.starts, self.ends)
        self.text = np.searchsorted(self.offsets, self.starts, side="right") - 1

    def spelled(self, first: int, count: int) -> bytes:
        return b" ".join(self.data[self.starts[first] : self.ends[first + count - 1]].tobytes().split())


class Matcher:
    """Shift tables, buckets and spellings of the windows of some items."""

    def __init__(self, ids: list[str], texts: list[str | None], window: int = WINDOW) -> None:
        words = Words(pa.array(texts, pa.string()), RollingHash())
        self.ids = ids
        windows: dict[bytes, tuple[np.ndarray, set[int]]] = {}
        bounds = np.searchsorted(words.text, np.arange(len(texts) + 1))
        for item, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            count = min(window, b - a)
            for first in range(a, b - count + 1) if count else ():
                spelled = words.spelled(first, count)
                windows.setdefault(spelled, (words.hashes[first : first + count], set()))[1].add(item)
        by_length: dict[int, list[bytes]] = {}
        for spelled, (hashes, _) in windows.items():
            by_length.setdefault(len(hashes), []).append(spelled)
        self.tables = []
        for length, spelled in sorted(by_length.items()):
            grid = np.array([windows[s][0] for s in spelled], np.uint64).reshape(len(spelled), length)
            block = min(2, length)
            shift = np.full(1 << TABLE_BITS, length - block + 1, np.int64)
            for end in range(block - 1, length):
                np.minimum.at(shift, self._block(grid[:, end - block + 1], grid[:, end]), length - 1 - end)
            last = self._block(grid[:, length - block], grid[:, length - 1])
            by = np.argsort(last, kind="stable")
            self.tables.append((length, shift, grid[by], np.searchsorted(last[by], np.arange((1 << TABLE_BITS) + 1)), [spelled[k] for k in by], [sorted(windows[spelled[k]][1]) for k in by]))

    @staticmethod
    def _block(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (mix64(left * np.uint64(3) + right) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    @staticmethod
    def stops(words: Words, length: int, shift: np.ndarray) -> np.ndarray:
        """The words at which a window of that length may end: where its shift table lets no skip."""
        n, block = len(words.hashes), min(2, length)
        at = np.arange(length - 1, n, max(1, -(-n // LANES)))
        stop = np.concatenate([at[1:], [n]])
        ends = [np.zeros(0, np.int64)]
        while len(at):
            skip = shift[Matcher._block(words.hashes[at - block + 1], words.hashes[at])]
            ends.append(at[skip == 0])
            at = at + np.maximum(skip, 1)
            going = at < stop
            at, stop = at[going], stop[going]
        return np.concatenate(ends)

    def find(self, words: Words) -> Iterator[tuple[np.ndarray, int, np.ndarray, list[list[int]]]]:
        """(first words, length, windows, the windows' items) of all occurrences, by window length."""
        n = len(words.hashes)
        for length, shift, grid, bucket, spelled, items in self.tables:
            if n < length:
                continue
            block = min(2, length)
            end = self.stops(words, length, shift)
            slot = self._block(words.hashes[end - block + 1], words.hashes[end])
            size = bucket[slot + 1] - bucket[slot]
            end = np.repeat(end, size)
            which = np.repeat(bucket[slot], size) + np.arange(len(end)) - np.repeat(np.cumsum(size) - size, size)
            alike = words.text[end] == words.text[end - length + 1]
            for k in range(length):
                alike[alike] = words.hashes[end[alike] - k] == grid[which[alike], length - 1 - k]
            first, which = end[alike] - length + 1, which[alike]
            same = np.array([words.spelled(a, length) == spelled[w] for a, w in zip(first.tolist(), which.tolist(), strict=True)], bool)
            yield first[same], length, which[same], items


def _found(texts: pa.Array, matcher: Matcher, rolling: RollingHash) -> tuple[np.ndarray, np.ndarray, list[set[str]], np.ndarray, np.ndarray]:
    """Word counts and hit counts of each text, its items, and the hit words as (first, last) runs of all words."""
    words = Words(texts, rolling)
    n, count = len(texts), len(words.hashes)
    change = np.zeros(count + 1, np.int64)
    items: list[set[str]] = [set() for _ in range(n)]
    for first, length, which, of in matcher.find(words):
        np.add.at(change, first, 1)
        np.add.at(change, first + length, -1)
        for row, w in set(zip(words.text[first].tolist(), which.tolist(), strict=True)):
            items[row].update(matcher.ids[k] for k in of[w])
    hit = np.cumsum(change)[:-1] > 0
    return np.bincount(words.text, minlength=n), np.bincount(words.text[hit], minlength=n), items, hit, words.text


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, text), each once."""
    return benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).cast("string").alias("text")).distinct()


def _matcher(items: DataFrame, item_bytes: int) -> Matcher | None:
    """The matcher of a benchmark that is small enough to go to every task."""
    if (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > item_bytes:
        return None
    rows = items.toArrow()
    return Matcher(rows.column(0).to_pylist(), rows.column(1).to_pylist())


def _runs(n_words: np.ndarray, hit: np.ndarray, text: np.ndarray, rows: int) -> list[list[dict]]:
    """The runs of hit words of each text."""
    base = np.cumsum(n_words) - n_words
    new = np.concatenate([[True], text[1:] != text[:-1]])[: len(text)]
    edge = np.flatnonzero(hit & (new | ~np.concatenate([[False], hit[:-1]])))
    close = np.flatnonzero(hit & (np.concatenate([new[1:], [True]])[: len(hit)] | ~np.concatenate([hit[1:], [False]])))
    runs: list[list[dict]] = [[] for _ in range(rows)]
    for row, a, b in zip(text[edge].tolist(), (edge - base[text[edge]]).tolist(), (close - base[text[close]]).tolist(), strict=True):
        runs[row].append({"first": a, "last": b})
    return runs


RUN = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
FOUND = "n_words long, n_hit long, items array<string>, runs array<struct<first: long, last: long>>"


def _columns(n_words: np.ndarray, n_hit: np.ndarray, items: list[set[str]], runs: list[list[dict]]) -> list[pa.Array]:
    return [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([sorted(s) for s in items], pa.list_(pa.string())), pa.array(runs, RUN)]


def search(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(id, n_words, n_hit, items, runs): runs are the hit words as (first, last) word numbers."""
    id_type = docs.schema[id_col].dataType.simpleString()
    items = _items(benchmark, item_id_col, item_text_col)
    matcher = _matcher(items, item_bytes)
    if matcher is None:
        return _by_join(docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text")), items).select(F.col("__id").alias(id_col), "n_words", "n_hit", "items", "runs")
    sent = docs.sparkSession.sparkContext.broadcast(matcher)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = RollingHash()
        for block in blocks(batches, 1):
            n_words, n_hit, found, hit, text = _found(block.column(1), sent.value, rolling)
            columns = _columns(n_words, n_hit, found, _runs(n_words, hit, text, block.num_rows))
            yield pa.RecordBatch.from_arrays([block.column(0), *columns], names=[id_col, "n_words", "n_hit", "items", "runs"])

    return docs.select(id_col, F.col(text_col).cast("string").alias("__text")).mapInArrow(run, f"`{id_col}` {id_type}, {FOUND}")


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", item_bytes: int = ITEM_BYTES) -> DataFrame:
    """The rows of `docs`, all columns, without a hit."""
    at = docs.columns.index(text_col)
    items = _items(benchmark, item_id_col, item_text_col)
    matcher = _matcher(items, item_bytes)
    if matcher is None:
        named = docs.select(F.struct(*docs.columns).alias("__id"), F.col(text_col).cast("string").alias("__text"))
        return _by_join(named, items).where("n_hit = 0").select("__id.*")
    sent = docs.sparkSession.sparkContext.broadcast(matcher)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = RollingHash()
        for block in blocks(batches, at):
            yield block.filter(pa.array(_found(block.column(at), sent.value, rolling)[1] == 0))

    return docs.mapInArrow(run, docs.schema)


# ---- a benchmark too large for every task


def _window_hash(words: np.ndarray, first: np.ndarray, length: int) -> np.ndarray:
    out = np.full(len(first), length, np.uint64)
    for k in range(length):
        out = mix64(out + words[first + k])
    return out.view(np.int64)


def _windows_of(words: Words, count: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, item rows, first words) of the windows of items, by length."""
    bounds = np.searchsorted(words.text, np.arange(count + 1))
    lengths = np.minimum(WINDOW, np.diff(bounds))
    for length in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == length)
        each = bounds[rows + 1] - bounds[rows] - length + 1
        first = np.repeat(bounds[rows] - np.cumsum(each) + each, each) + np.arange(each.sum())
        yield length, np.repeat(rows, each), first


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (item, text) to (length, h, spelled, item)."""
    for block in blocks(batches, 1):
        words = Words(block.column(1), RollingHash())
        for length, row, first in _windows_of(words, block.num_rows):
            spelled = [words.spelled(a, length) for a in first.tolist()]
            columns = [pa.array(np.full(len(first), length, np.int32)), pa.array(_window_hash(words.hashes, first, length)), pa.array(spelled, pa.binary()), block.column(0).take(pa.array(row))]
            yield pa.RecordBatch.from_arrays(columns, names=["length", "h", "spelled", "item"])


def _item_shifts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (item, text) to the entries (length, slot, shift) of shift tables that are below their default."""
    tables: dict[int, np.ndarray] = {}
    for block in blocks(batches, 1):
        words = Words(block.column(1), RollingHash())
        for length, _, first in _windows_of(words, block.num_rows):
            size = min(2, length)
            table = tables.setdefault(length, np.full(1 << TABLE_BITS, length - size + 1, np.int64))
            for end in range(size - 1, length):
                np.minimum.at(table, Matcher._block(words.hashes[first + end - size + 1], words.hashes[first + end]), length - 1 - end)
    for length, table in tables.items():
        slot = np.flatnonzero(table <= length - min(2, length))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(slot), length, np.int32)), pa.array(slot.astype(np.int32)), pa.array(table[slot].astype(np.int32))], names=["length", "slot", "shift"])


def _shift_tables(items: DataFrame) -> dict[int, np.ndarray]:
    """By window length: at most 2 to the TABLE_BITS entries for each of at most WINDOW lengths."""
    found = items.mapInArrow(_item_shifts, "length int, slot int, shift int").groupBy("length", "slot").agg(F.min("shift").alias("shift")).toArrow()
    length, slot, shift = (c.to_numpy() for c in found.columns)
    out = {}
    for n in np.unique(length).tolist():
        out[n] = np.full(1 << TABLE_BITS, n - min(2, n) + 1, np.int64)
        out[n][slot[length == n]] = shift[length == n]
    return out


def _by_join(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(__id, n_words, n_hit, items, runs) of documents (__id, __text)."""
    windows = cut_lineage(items.mapInArrow(_item_windows, "length int, h long, spelled binary, item string").groupBy("length", "h", "spelled").agg(F.collect_set("item").alias("owners")))
    sent = docs.sparkSession.sparkContext.broadcast(_shift_tables(items))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = RollingHash()
        for block in blocks(batches, 1):
            words = Words(block.column(1), rolling)
            base = np.searchsorted(words.text, np.arange(block.num_rows + 1))
            for length, shift in sent.value.items():
                end = Matcher.stops(words, length, shift)
                first = end - length + 1
                first = first[words.text[end] == words.text[first]]
                row = words.text[first]
                columns = [block.column(0).take(pa.array(row)), pa.array(np.full(len(first), length, np.int32)), pa.array(_window_hash(words.hashes, first, length)), pa.array(first - base[row])]
                yield pa.RecordBatch.from_arrays(columns, names=["rid", "length", "h", "first"])

    rows = docs.withColumn("__rid", F.xxhash64(F.col("__text").isNull(), F.col("__text")))
    found = rows.select("__rid", "__text").mapInArrow(places, "rid long, length int, h long, first long").join(windows, ["length", "h"])
    by_row = found.groupBy(F.col("rid").alias("__rid")).agg(F.collect_set(F.struct("first", "length", "spelled", "owners")).alias("__places"))
    joined = rows.join(by_row, "__rid", "left").select("__text", "__places", "__id")
    schema = f"{FOUND}, __id {docs.schema['__id'].dataType.simpleString()}"

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = RollingHash()
        for block in blocks(batches, 0):
            words = Words(block.column(0), rolling)
            base = np.searchsorted(words.text, np.arange(block.num_rows + 1))
            hit = np.zeros(len(words.hashes), bool)
            owners: list[set[str]] = [set() for _ in range(block.num_rows)]
            for row, own in enumerate(block.column(1).to_pylist()):
                for x in own or ():
                    a = int(base[row]) + x["first"]
                    if words.spelled(a, x["length"]) == x["spelled"]:
                        hit[a : a + x["length"]] = True
                        owners[row].update(x["owners"])
            n_words = np.diff(base)
            n_hit = np.bincount(words.text[hit], minlength=block.num_rows)
            columns = _columns(n_words, n_hit, owners, _runs(n_words, hit, words.text, block.num_rows))
            yield pa.RecordBatch.from_arrays([*columns, block.column(2)], names=["n_words", "n_hit", "items", "runs", "__id"])

    return joined.mapInArrow(compared, schema)


def digest(items: Column) -> Column:
    """SHA-256 of item ids, sorted as strings and joined by commas."""
    return F.sha2(F.concat_ws(",", F.array_sort(items)), 256)
