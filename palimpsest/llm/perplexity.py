"""Quality rules: base counts of each text, and perplexity bands of a Kneser-Ney model by language.

The model is of lower-cased code points of any script, in n-grams of order 6, so it sees spelling and how words
follow one another. Spark counts the n-grams of all texts: a task gives the distinct ones of a chunk of its texts, by hash
buckets of the two code points before the last. All statistics of orders 3 to 6 are local to a bucket; those of orders 1 and 2 are summed
over buckets in SQL. The estimates are modified Kneser-Ney (three discounts an order, continuation counts below the
highest), kept in each bucket as a sorted array of 64-bit hashes beside their log-probabilities. Chunks then look their n-grams up
bucket by bucket, and texts meet the answers of their chunk. Nothing of the model is gathered: it grows with the corpus,
and what moves is a chunk's distinct n-grams, a few hundredths of its characters.

Texts are dealt into two folds by a hash, and each is scored by the model of the other fold: a text does not
vouch for its own n-grams, nor do its copies.

A text is rejected when its log-perplexity lies outside its language's band: the median of all texts of
the language that meet the base rules, and so many distances of the quartile on that side. How many is set
for each language and side by labelled texts: the width at which the share of bad texts outside exceeds that
of good texts by most while at most MOST_GOOD of these leave; or WIDTH where no width rejects more of the bad
texts, or fewer than LEAST_LABELLED texts of either kind are labelled.

The table is read twice, for requests and for scores, and chunks are stretches of what a task reads: a table whose
pieces differ between two reads (a shuffle's output, say) is to be written first; a difference is noticed and raises.

Edge cases: a null or empty text has no words and fails the base rules, and has no perplexity; null languages form a
language of their own; a very long text is a block of its own; texts that repeat count each time; an empty table gives an
empty result; a quartile distance below LEAST_DISTANCE counts as that, so equal quartiles leave room for rounding only; of
widths that gain alike the widest is taken; a text whose labels disagree is bad; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import RollingHash, blocks, cut_lineage, mix64, separated, text_buffer, word_bounds, written

ORDER = 6
#: Orders whose statistics are local to a bucket.
LOCAL = range(3, ORDER + 1)
BUCKET_BITS = 7
WIDTH = 8.0
LEAST_DISTANCE = 1e-6
LEAST_LABELLED = 20
#: What widths are chosen from, and the share of a language's good texts that may leave on a side.
WIDTHS = [k / 2 for k in range(2, 33)]
MOST_GOOD = 0.03
MIN_WORDS = 50
MOST_REPEATED = 50  # per cent of all words
SYMBOLS = b"#*$%&|<>"
#: Bytes of text in a chunk, and that a task works on at once.
CHUNK = 32 << 20
BLOCK = 1 << 19
#: Distinct n-grams that a task holds before it merges them.
HELD = 1 << 20
FOLDS = 2
#: What stands before the first code point and after the last one; bits of a code point.
BEGIN, END = 1, 2
POINT = np.uint64(21)
ONE_POINT, TWO_POINTS = np.uint64((1 << 21) - 1), np.uint64((1 << 42) - 1)
#: Of the packing of texts that are shuffled.
LEVEL = 5
SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: Log-probabilities are kept to so many parts of a bit.
STEPS = 256

IS_SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
IS_SYMBOL = np.array([b in SYMBOLS for b in range(256)])


class Grams(NamedTuple):
    """N-grams as their first and last three code points, and how often each fold holds them."""

    high: np.ndarray
    low: np.ndarray
    n: list[np.ndarray]


def ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last three code points of the n-gram that ends at each one, and after the last one, of every text; and the text of each."""
    lowered = [(t or "").lower() for t in texts]
    ahead, end = chr(BEGIN) * (ORDER - 1), chr(END)
    line = np.frombuffer("".join(f"{ahead}{t}{end}" for t in lowered if t).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = np.array([len(t) + ORDER if t else 0 for t in lowered], np.int64)
    if not len(line):
        return line, line, np.zeros(0, np.int64)
    starts = (np.cumsum(size) - size)[size > 0]
    own = np.ones(len(line), bool)
    own[(starts[:, None] + np.arange(ORDER - 1)).ravel()] = False
    three = line[:-2] << (POINT + POINT) | line[1:-1] << POINT | line[2:]
    ends = own[ORDER - 1 :]  # no n-gram ends before the first text's first code point
    return three[: len(ends)][ends], three[ORDER - 3 :][ends], np.repeat(np.arange(len(texts)), size)[own]


def hashes(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The hash of each n-gram; its first bits are those of the two code points before the last, so sorted hashes lie in buckets."""
    context = (low >> POINT) * SPREAD & np.uint64(0xFFFF000000000000)
    both = high * SPREAD + low
    both ^= both >> np.uint64(29)
    both *= np.uint64(0xBF58476D1CE4E5B9)
    both ^= both >> np.uint64(32)
    return context | both >> np.uint64(16)


def distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of the keys, where each distinct one begins in it, and how often it occurs."""
    by = np.argsort(key)
    ordered = key[by]
    firsts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(by) else by
    return by, firsts, np.diff(np.concatenate([firsts, [len(by)]]))


def merged(parts: list[Grams]) -> Grams:
    """Distinct n-grams in the order of their hashes, with summed counts."""
    high, low, *n = (np.concatenate(c) for c in zip(*((g.high, g.low, *g.n) for g in parts), strict=True))
    by, firsts, _ = distinct(hashes(high, low))
    return Grams(high[by][firsts], low[by][firsts], [np.add.reduceat(c[by], firsts) if len(by) else c for c in n])


def sorted_by_points(grams: Grams) -> Grams:
    by = np.lexsort((grams.low, grams.high))
    return Grams(grams.high[by], grams.low[by], [c[by] for c in grams.n])


def _pack(columns: list[np.ndarray], kind: str) -> bytes:
    planes = np.stack(columns).astype(kind)
    n = planes.shape[1]
    raw = planes.view(np.uint8).reshape(len(columns), n, -1).transpose(0, 2, 1).tobytes()
    return n.to_bytes(4, "little") + bytes(pa.compress(raw, "zstd"))


def _unpack(blob: bytes, columns: int, kind: str) -> np.ndarray:
    n, width = int.from_bytes(blob[:4], "little"), np.dtype(kind).itemsize
    raw = np.frombuffer(pa.decompress(blob[4:], columns * n * width, "zstd"), np.uint8)
    return np.ascontiguousarray(raw.reshape(columns, width, n).transpose(0, 2, 1)).view(kind).reshape(columns, n)


def packed(grams: Grams) -> bytes:
    points = [part >> shift & ONE_POINT for part in (grams.high, grams.low) for shift in (POINT + POINT, POINT, np.uint64(0))]
    return _pack([*points, *grams.n], "<u4")


def unpacked(blob: bytes) -> Grams:
    c = _unpack(blob, 6 + FOLDS, "<u4").astype(np.uint64)
    three = lambda k: c[k] << (POINT + POINT) | c[k + 1] << POINT | c[k + 2]
    return Grams(three(0), three(3), [v.astype(np.int64) for v in c[6:]])


# ---- requests: the distinct n-grams of chunks


def _rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.pmod(F.xxhash64(text), F.lit(FOLDS)).cast("int").alias("fold"), text.alias("__text"), F.spark_partition_id().alias("part"))


def chunked(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(chunk, block): chunks are stretches of CHUNK bytes of text of what the task reads, whatever batches it comes in."""
    read = 0
    for block in blocks(batches, 3, BLOCK):
        part = block.column(4)[0].as_py()
        _, offsets = text_buffer(block.column(3))
        number = (read + offsets[:-1]) // CHUNK
        read += int(offsets[-1])
        cuts = np.flatnonzero(np.diff(number)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), block.num_rows], strict=True):
            yield part << 32 | int(number[a]), block.slice(a, b - a)


def _by_language(block: pa.RecordBatch) -> Iterator[tuple[str, pa.RecordBatch]]:
    langs = np.array(block.column(1).to_pylist(), object).astype(str)
    for lang in np.unique(langs).tolist():
        yield lang, block.filter(pa.array(langs == lang))


def counted(block: pa.RecordBatch) -> list[Grams]:
    """The distinct n-grams of a block of rows of one language, fold by fold."""
    high, low, row = ngrams(block.column(3).to_pylist())
    fold, key = block.column(2).to_numpy()[row], hashes(high, low)
    out = []
    for f in range(FOLDS):
        own = np.flatnonzero(fold == f)
        by, firsts, n = distinct(key[own])
        first = by[firsts]
        out.append(Grams(high[own[first]], low[own[first]], [n if k == f else np.zeros_like(n) for k in range(FOLDS)]))
    return out


REQUESTS = "chunk long, lang string, bucket int, blob binary"


def _requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[Grams]] = {}
    size, current = 0, None

    def given() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            grams = merged(parts)
            bucket = (hashes(grams.high, grams.low) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            rows = []
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(bucket)], strict=True):
                if b > a:
                    own = Grams(grams.high[a:b], grams.low[a:b], [c[a:b] for c in grams.n])
                    rows.append((current, lang, int(bucket[a]), packed(sorted_by_points(own))))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int32(), pa.binary()), strict=True)], names=["chunk", "lang", "bucket", "blob"])
        held.clear()

    for chunk, block in chunked(batches):
        if chunk != current:
            yield from given()
            current, size = chunk, 0
        for lang, own in _by_language(block):
            new = counted(own)
            held.setdefault(lang, []).extend(new)
            size += sum(len(g.high) for g in new)
        if size > HELD:
            for lang, parts in held.items():
                held[lang] = [merged(parts)]
            size = 0
    yield from given()


# ---- the model


class Level(NamedTuple):
    """The types of one order, sorted by their code points."""

    of: np.ndarray  # for each type of the order above: its type here
    context: np.ndarray  # of each type, numbered
    low: np.ndarray


def levels(grams: Grams) -> dict[int, Level]:
    """Types and contexts of the local orders, from distinct n-grams sorted by their code points."""
    high, low = grams.high, grams.low
    of = np.arange(len(high))
    out = {}
    for order in reversed(LOCAL):
        if order < ORDER:
            high = high & np.uint64((1 << 21 * (order - 3)) - 1)
            by = np.lexsort((low, high))
            high, low = high[by], low[by]
            new = np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])])
            of = np.empty(len(by), np.int64)
            of[by] = np.cumsum(new) - 1
            high, low = high[new], low[new]
        outer = low >> POINT
        context = np.cumsum(np.concatenate([[True], (high[1:] != high[:-1]) | (outer[1:] != outer[:-1])])) - 1
        out[order] = Level(of, context, low)
    return out


def counts_by_order(n: np.ndarray, types: dict[int, Level]) -> dict[int, np.ndarray]:
    """Counts of the highest order, and below it how many types of the order above end in each."""
    out = {ORDER: n}
    for order in range(ORDER - 1, LOCAL[0] - 1, -1):
        out[order] = np.bincount(types[order].of[out[order + 1] > 0], minlength=len(types[order].low))
    return out


MODEL = "lang string, bucket int, kind string, order int, model int, a long, b long, c long, d long, blob binary"


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with the same first `keys` values, a batch's part of a run at a time."""
    for batch in batches:
        run: list[tuple] = []
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if run and run[-1][:keys] != row[:keys]:
                yield run[-1][:keys], run
                run = []
            run.append(row)
        if run:
            yield run[-1][:keys], run


def _model(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, bucket, blob), sorted, to MODEL: the bucket's n-grams, its pairs and its counts of counts."""
    current, parts = None, []

    def given() -> pa.RecordBatch:
        lang, bucket = current
        grams = sorted_by_points(merged(parts))
        types = levels(grams)
        by_model = [counts_by_order(n, types) for n in grams.n]
        rows = [(lang, bucket, "grams", None, None, None, None, None, None, packed(grams))]
        last_two, pair = np.unique(types[3].low & TWO_POINTS, return_inverse=True)
        pairs = [np.bincount(pair[counts[3] > 0], minlength=len(last_two)).tolist() for counts in by_model]
        for two, *n in zip(last_two.tolist(), *pairs, strict=True):
            rows.append((lang, bucket, "pairs", 2, None, two >> 21, two & (1 << 21) - 1, *n, None))
        for model, counts in enumerate(by_model):
            rows += [(lang, bucket, "counts", order, model, *(int((n == k).sum()) for k in (1, 2, 3, 4)), None) for order, n in counts.items()]
        types_ = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types_, strict=True)], names=[c.split()[0] for c in MODEL.split(", ")])

    for key, run in _grouped(batches, 2):
        if current not in (None, key):
            yield given()
            parts = []
        current = key
        parts += [unpacked(blob) for *_, blob in run]
        if sum(len(g.high) for g in parts) > HELD:
            parts = [merged(parts)]
    if current is not None:
        yield given()


def _discounts(n: tuple[int, ...]) -> list[float]:
    """The discounts of counts 1, 2 and 3 or more, from how many types have the counts 1 to 4."""
    n1, n2, n3, n4 = n
    if not n1 or not n2:
        return [0.5, 0.5, 0.5]
    y = n1 / (n1 + 2 * n2)
    out = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(d, 0.05), k) for d, k in zip(out, (1, 2, 3), strict=True)]


DISCOUNTS = """CASE WHEN n1 = 0 OR n2 = 0 THEN 0.5D ELSE least(greatest(1 - 2 * n1 / (n1 + 2 * n2) * n2 / nullif(n1, 0), 0.05), 1) END AS d1,
CASE WHEN n1 = 0 OR n2 = 0 THEN 0.5D ELSE least(greatest(2 - 3 * n1 / (n1 + 2 * n2) * n3 / nullif(n2, 0), 0.05), 2) END AS d2,
CASE WHEN n1 = 0 OR n2 = 0 THEN 0.5D ELSE least(greatest(coalesce(3 - 4 * n1 / (n1 + 2 * n2) * n4 / nullif(n3, 0), 1.5), 0.05), 3) END AS d3"""


def _estimates(rows: DataFrame, points: list[str]) -> DataFrame:
    """`rows` (lang, model, points, c, below) with p, the estimate of the last point after the others; `below` is that of the order below."""
    key = ["lang", "model"]
    counts = rows.groupBy(key).agg(*[F.count_if(F.col("c") == k).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)])
    off = F.expr("CASE WHEN c = 0 THEN 0D WHEN c = 1 THEN d1 WHEN c = 2 THEN d2 ELSE d3 END")
    rows = rows.join(F.broadcast(counts.selectExpr(*key, *DISCOUNTS.split(",\n"))), key).withColumn("off", off)
    context = key + points[:-1]
    totals = rows.groupBy(context).agg(F.sum("c").alias("total"), F.sum("off").alias("all_off"))
    both = rows.join(totals, context)
    share = F.expr("CASE WHEN total = 0 THEN below ELSE (c - off) / total + all_off / total * below END")
    return both.select(*key, *points, share.alias("p"))


def _pair_estimates(pairs: DataFrame) -> DataFrame:
    """(lang, bucket, c5, c6, p0, p1) of each pair that a bucket needs, from (lang, bucket, c5, c6, n0, n1)."""
    models = "inline(array(struct(0 AS model, n0 AS c), struct(1 AS model, n1 AS c)))"
    twos = cut_lineage(pairs.groupBy("lang", "c5", "c6").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).selectExpr("lang", "c5", "c6", models))
    ones = twos.groupBy("lang", "model", "c6").agg(F.count_if(F.col("c") > 0).alias("c"))
    size = ones.groupBy("lang", "model").agg((1 / F.count(F.lit(1))).alias("below"))  # every code point of the language is as likely
    one = _estimates(ones.join(F.broadcast(size), ["lang", "model"]), ["c6"]).withColumnRenamed("p", "below")
    two = _estimates(twos.join(one, ["lang", "model", "c6"]), ["c5", "c6"])
    both = two.groupBy("lang", "c5", "c6").agg(*[F.max(F.when(F.col("model") == m, F.col("p"))).alias(f"p{m}") for m in range(FOLDS)])
    return pairs.select("lang", "bucket", "c5", "c6").join(both, ["lang", "c5", "c6"])


def hash_array(grams: Grams, pairs: list[tuple], discounts: dict[tuple[int, int], list[float]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of a bucket's n-grams, and their log-probabilities under each model, in STEPS of a bit.

    `pairs` are (c5, c6, estimate of each model), `discounts` by order and model.
    """
    types = levels(grams)
    known = sorted(pairs)
    two = np.array([a << 21 | b for a, b, *_ in known], np.uint64)
    at = np.searchsorted(two, types[3].low & TWO_POINTS)
    values = []
    for model, n in enumerate(grams.n):
        counts = counts_by_order(n, types)
        p = np.array([row[2 + model] for row in known])[at]
        for order in LOCAL:
            c, context = counts[order], types[order].context
            if order > LOCAL[0]:
                p = p[types[order - 1].of]
            off = np.array([0.0, *discounts[order, model]])[np.minimum(c, 3)]
            total, spare = np.bincount(context, weights=c), np.bincount(context, weights=off)
            whole = np.maximum(total, 1)
            p = np.where(total[context] > 0, (c - off) / whole[context] + (spare / whole)[context] * p, p)
        values.append(np.round(np.log2(p) * STEPS).clip(-32768, 0).astype(np.int16))
    key = hashes(grams.high, grams.low)
    by = np.argsort(key, kind="stable")
    return key[by], np.stack(values)[:, by]


ANSWERS = "chunk long, lang string, bucket int, blob binary"


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, bucket, rank, chunk, a, b, x, y, z, blob), sorted, to ANSWERS: discounts and pairs come first, then the n-grams, then requests."""
    current, array = None, None
    pairs: list[tuple] = []
    discounts: dict[tuple[int, int], list[float]] = {}
    for key, run in _grouped(batches, 2):
        if key != current:
            current, array, pairs, discounts = key, None, [], {}
        found = []
        for _, _, rank, chunk, a, b, x, y, z, blob in run:
            if rank == 0:
                discounts[a, b] = [x, y, z]
            elif rank == 1:
                pairs.append((a, b, x, y))
            elif rank == 2:
                array = hash_array(unpacked(blob), pairs, discounts)
            else:
                asked = unpacked(blob)
                wanted = np.sort(hashes(asked.high, asked.low))
                found.append((chunk, *key, _pack(list(array[1][:, np.searchsorted(array[0], wanted)]), "<i2")))
        if found:
            columns = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int32(), pa.binary()), strict=True)], names=["chunk", "lang", "bucket", "blob"])


def answers(requests: DataFrame) -> DataFrame:
    """The log-probabilities that each chunk asks for, bucket by bucket, in the order of the hashes."""
    ordered = requests.select("lang", "bucket", "blob").repartition("lang", "bucket").sortWithinPartitions("lang", "bucket")
    model = written(ordered.mapInArrow(_model, MODEL), "ngrams")
    pairs = _pair_estimates(model.where("kind = 'pairs'").selectExpr("lang", "bucket", "a AS c5", "b AS c6", "c AS n0", "d AS n1"))
    sums = [F.sum(c).cast("double").alias(f"n{k}") for k, c in enumerate("abcd", 1)]
    off = model.where("kind = 'counts'").groupBy("lang", "order", "model").agg(*sums).selectExpr("lang", "order", "model", *DISCOUNTS.split(",\n"))
    grams = model.where("kind = 'grams'")
    off = grams.select("lang", "bucket").join(F.broadcast(off), "lang")  # a few rows a language
    none = "CAST(NULL AS BIGINT)"
    rows = [
        off.selectExpr("lang", "bucket", "0 AS rank", f"{none} AS chunk", "CAST(order AS BIGINT) AS a", "CAST(model AS BIGINT) AS b", "d1 AS x", "d2 AS y", "d3 AS z", "CAST(NULL AS BINARY) AS blob"),
        pairs.selectExpr("lang", "bucket", "1 AS rank", f"{none} AS chunk", "c5 AS a", "c6 AS b", "p0 AS x", "p1 AS y", "0D AS z", "CAST(NULL AS BINARY) AS blob"),
        grams.selectExpr("lang", "bucket", "2 AS rank", f"{none} AS chunk", f"{none} AS a", f"{none} AS b", "0D AS x", "0D AS y", "0D AS z", "blob"),
        requests.selectExpr("lang", "bucket", "3 AS rank", "chunk", f"{none} AS a", f"{none} AS b", "0D AS x", "0D AS y", "0D AS z", "blob"),
    ]
    every = rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])
    return every.repartition("lang", "bucket").sortWithinPartitions("lang", "bucket", "rank").mapInArrow(_answers, ANSWERS)


# ---- scores


def _sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows as packed record batches, with their chunk."""
    for chunk, block in chunked(batches):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, block.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=LEVEL))) as out:
            out.write_batch(block)
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([None], pa.string()), pa.array([None], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk", "lang", "bucket", "blob"])


def _scored(held: list[bytes], known: dict[str, list[np.ndarray]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of one chunk with counts and log-perplexity."""
    found: dict[str, list[np.ndarray]] = {}
    for blob in held:
        for lang, own in _by_language(pa.ipc.open_stream(blob).read_next_batch()):
            high, low, _ = ngrams(own.column(3).to_pylist())
            parts = found.setdefault(lang, [])
            key = np.sort(hashes(high, low))
            parts.append(key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key)
            if sum(map(len, parts)) > HELD:
                parts[:] = [np.unique(np.concatenate(parts))]
    arrays = {}
    for lang, parts in found.items():
        keys, values = np.unique(np.concatenate(parts)), np.concatenate(known.get(lang, [np.zeros((FOLDS, 0), np.int16)]), axis=1)
        if len(keys) != values.shape[1]:
            raise ValueError("the table was read in other pieces the second time; write it first")
        arrays[lang] = keys, values
    rolling = RollingHash()
    for blob in held:
        for lang, own in _by_language(pa.ipc.open_stream(blob).read_next_batch()):
            high, low, row = ngrams(own.column(3).to_pylist())
            keys, values = arrays[lang]
            key = hashes(high, low)
            by = np.argsort(key)  # neighbours are found faster
            row = row[by]
            bits = values[1 - own.column(2).to_numpy()[row], np.searchsorted(keys, key[by])] if len(keys) else np.zeros(0)
            n = np.bincount(row, minlength=own.num_rows)
            mean = -np.bincount(row, weights=bits, minlength=own.num_rows) / STEPS / np.maximum(n, 1)
            counts = [pa.array(c, pa.int64()) for c in base_counts(own.column(3), rolling)]
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), *counts, pa.array(mean, pa.float64(), mask=n == 0)], names=names)


def base_counts(texts: pa.Array, rolling: RollingHash) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    data, offsets = separated(texts)
    n = len(texts)
    word_byte = ~IS_SPACE[data]
    starts, ends = word_bounds(word_byte)
    of = np.searchsorted(offsets, starts, side="right") - 1
    rolling.load(data)

    def total(mask: np.ndarray) -> np.ndarray:
        so_far = np.concatenate([[0], np.cumsum(mask)])
        return so_far[offsets[1:]] - so_far[offsets[:-1]]

    breaks = data == 10
    breaks[offsets[1:] - 1] = True
    line_end = np.flatnonzero(breaks)
    line_start = np.concatenate([[0], line_end + 1])[:-1]
    with_word = np.zeros(len(line_end), bool)
    with_word[np.searchsorted(line_end, starts)] = True
    line_of = np.searchsorted(offsets, line_start, side="right") - 1
    line = mix64(rolling.of(line_start, line_end) + line_of.astype(np.uint64))[with_word]
    _, first = np.unique(line, return_index=True)
    dup = np.ones(len(line), bool)
    dup[first] = False

    words = rolling.of(starts, ends)
    repeated = np.zeros(len(words), np.int64)
    if len(words) >= 3:
        inside = of[2:] == of[:-2]
        triple = mix64(mix64(mix64(words[:-2]) + words[1:-1]) + words[2:] + of[:-2].astype(np.uint64))[inside]
        _, code, times = np.unique(triple, return_inverse=True, return_counts=True)
        at = np.flatnonzero(inside)[times[code] > 1]
        for k in range(3):
            repeated[at + k] = 1
    return [
        np.bincount(of, minlength=n),
        total(word_byte & (data & 0xC0 != 0x80)),
        total(IS_SYMBOL[data]),
        np.bincount(line_of[with_word][dup], minlength=n),
        np.bincount(of, weights=repeated, minlength=n).astype(np.int64),
    ]


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, lang, the base counts, log_perplexity): bits for each code point under the model of the row's language and the other fold."""
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = _rows(docs, id_col, text_col, lang_col)
    requests = written(rows.mapInArrow(_requests, REQUESTS), "requests")
    names = [id_col, "lang", *COUNTS, "log_perplexity"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, known = None, [], {}
        for (chunk,), part in _grouped(batches, 1):
            if chunk != current and held:
                yield from _scored(held, known, names)
            if chunk != current:
                current, held, known = chunk, [], {}
            for _, lang, _, blob in part:  # answers come first, in the order of languages and buckets
                if lang is None:
                    held.append(blob)
                else:
                    known.setdefault(lang, []).append(_unpack(blob, FOLDS, "<i2"))
        if held:
            yield from _scored(held, known, names)

    every = answers(requests).unionByName(rows.mapInArrow(_sent, ANSWERS))
    ordered = every.repartition("chunk").sortWithinPartitions("chunk", F.col("lang").isNull(), "lang", "bucket")
    counts = ", ".join(f"{c} long" for c in COUNTS)
    return ordered.select("chunk", "lang", "bucket", "blob").mapInArrow(run, f"`{id_col}` {id_type}, lang string, {counts}, log_perplexity double")


def _widths(rows: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """(lang, lower_width, upper_width) from the labelled rows of `rows` (id, lang, side, away)."""
    bad = labels.where("quality is not null").groupBy(id_col).agg((F.min("quality") == 0).alias("bad"))
    labelled = rows.join(bad, id_col)
    out = labelled.withColumn("width", F.explode(F.array(*map(F.lit, WIDTHS))))
    counts = [F.count_if(F.col("bad") & (F.col("away") > F.col("width"))).alias("bad_out"), F.count_if(~F.col("bad") & (F.col("away") > F.col("width"))).alias("good_out")]
    out = out.groupBy("lang", "side", "width").agg(*counts)
    of = labelled.groupBy("lang").agg(F.count_if("bad").alias("n_bad"), F.count_if(~F.col("bad")).alias("n_good"))
    out = out.join(of.where(f"n_bad >= {LEAST_LABELLED} and n_good >= {LEAST_LABELLED}"), "lang")
    gain = F.round(F.col("bad_out") / F.col("n_bad") - F.col("good_out") / F.col("n_good"), 9)
    allowed = (gain > 0) & (F.col("good_out") <= MOST_GOOD * F.col("n_good"))
    best = [F.max_by("width", F.when(allowed & (F.col("side") == side), F.struct(gain, F.col("width")))).alias(f"{side}_width") for side in ("lower", "upper")]
    return out.groupBy("lang").agg(*best)


def banded(rows: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", width: float = WIDTH) -> DataFrame:
    """`rows` (id, lang, base_failed, log_perplexity, ...) with lower, upper and kept; `labels` are (id, quality 0 or 1)."""
    quartiles = F.percentile_approx("log_perplexity", [0.25, 0.5, 0.75], 10_000)
    bands = rows.where(~F.col("base_failed")).groupBy("lang").agg(quartiles.alias("q"))
    distance = [F.greatest(F.lit(LEAST_DISTANCE), F.col("q")[k + 1] - F.col("q")[k]).alias(name) for k, name in enumerate(("below", "above"))]
    bands = bands.select("lang", F.col("q")[1].alias("mid"), *distance)
    if labels is None:
        bands = bands.withColumn("lower_width", F.lit(width)).withColumn("upper_width", F.lit(width))
    else:
        bands = cut_lineage(bands)
        off = F.col("log_perplexity") - F.col("mid")
        placed = rows.where(~F.col("base_failed")).join(F.broadcast(bands), "lang")
        placed = placed.select(id_col, "lang", F.when(off < 0, "lower").otherwise("upper").alias("side"), F.when(off < 0, -off / F.col("below")).otherwise(off / F.col("above")).alias("away"))
        bands = bands.join(_widths(placed, labels, id_col), "lang", "left").fillna(width, ["lower_width", "upper_width"])
    bands = bands.selectExpr("lang", "mid - below * lower_width AS lower", "mid + above * upper_width AS upper")
    within = F.col("log_perplexity").between(F.col("lower"), F.col("upper"))
    return rows.join(F.broadcast(bands), "lang", "left").withColumn("kept", ~F.col("base_failed") & F.coalesce(within, F.lit(False)))


def judged(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", width: float = WIDTH) -> DataFrame:
    """Counts and log-perplexity of every row, with base_failed and kept."""
    rows = cut_lineage(measured(docs, id_col, text_col, lang_col))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return banded(rows.withColumn("base_failed", failed), labels, id_col, width)
