"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct byte n-grams of the lower-cased text, hashed to a fixed number of
slots. For each slot, r is the log ratio of its smoothed share among toxic documents to that
among the others; a logistic regression is fitted on presence times r, in which both classes weigh the same, so a score
is the probability of a toxic text where either class is as likely. It uses the TELLING slots that are spread most unevenly
over the classes, of those that chance would not bring: beyond so many standard errors that fewer than one
of all slots is expected there. A fixed model of one weight a slot goes to the tasks, and each whole text is
scored where it lies: no shuffle.

Training takes at most `per_class` labelled documents of either class, those of the smallest hash of their id.

Edge cases: a null or empty text has no features and scores the intercept; a very long text is scored as a block of its own;
a document with several label rows counts as toxic if any says so, and one with several texts gives the text of the
smallest hash; null labels and ids are not learned from; with labels of one class only, or none, every score is that
class's smoothed share; slots spread alike go by their number; rows that repeat are scored alike; scores are
rounded, as sums differ in the last digits with the order; an empty table gives an empty result; other columns, whatever
their names, are ignored or carried on.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import blocks, cut_lineage, mix64, text_buffer

LENGTHS = (4, 6, 8)
SLOT_BITS = 20
#: Labelled documents of each class that the fit uses at most.
PER_CLASS = 2500
#: Slots that carry weight at most.
TELLING = 2000
#: Standard errors beyond which less than one of all slots falls by chance.
LEAST_SIGMAS = -NormalDist().inv_cdf(0.5 / (1 << SLOT_BITS))
PENALTY = 3e-4
DIGITS = 9
THRESHOLD = 0.7

#: What a byte counts as: A-Z are lower-cased, ASCII punctuation and control characters are spaces.
FOLDED = np.array([b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256)], np.uint8)


class Model(NamedTuple):
    weights: np.ndarray
    intercept: float


def grams(data: np.ndarray) -> Iterator[np.ndarray]:
    """For each length, the slot of the n-gram that starts at each byte."""
    folded = FOLDED[data].astype(np.uint64)
    for length in LENGTHS:
        n = max(0, len(data) - length + 1)
        key = np.zeros(n, np.uint64)
        for k in range(length):
            key = key << np.uint64(8) | folded[k : n + k]
        yield (mix64(key + np.uint64(length)) >> np.uint64(64 - SLOT_BITS)).astype(np.int32)


def padded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, a space before and after each, and n + 1 offsets that leave those spaces inside."""
    data, offsets = text_buffer(texts)
    n = len(offsets) - 1
    out = np.full(len(data) + 2 * n, 32, np.uint8)
    starts = offsets + 2 * np.arange(n + 1)
    inside = np.ones(len(out), bool)
    inside[starts[:-1]] = inside[starts[1:] - 1] = False
    out[inside] = data
    return out, starts


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, 0):
        data, offsets = padded(block.column(0))
        by_length = list(grams(data))
        found = []
        for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            own = [slots[start : max(start, end - length + 1)] for length, slots in zip(LENGTHS, by_length, strict=True)]
            found.append(np.unique(np.concatenate(own)).astype("<i4").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), block.column(1)], names=["slots", "toxic"])


def sample(labels: DataFrame, learn_from: Column, per_class: int = PER_CLASS, id_col: str = "doc_id", label_col: str = "toxic") -> tuple[DataFrame, int, int]:
    """The labelled ids to train on, and how many labelled training ids are toxic and not."""
    known = labels.where(learn_from & F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    known = known.groupBy(id_col).agg(F.max((F.col(label_col) != 0).cast("int")).alias("toxic"))
    totals = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = (F.xxhash64(F.col(id_col)), F.col(id_col))
    chosen = [known.where(F.col("toxic") == c).orderBy(*order).limit(per_class) for c in (0, 1)]
    return chosen[0].unionByName(chosen[1]), totals.get(1, 0), totals.get(0, 0)


def train(docs: DataFrame, labels: DataFrame, learn_from: Column, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fits the classifier on at most 2 * per_class documents, the bound of all that is gathered."""
    chosen, toxic, clean = sample(labels, learn_from, per_class, id_col, label_col)
    prior = float(np.log((toxic + 0.5) / (clean + 0.5)))
    none = Model(np.zeros(1 << SLOT_BITS, np.float32), prior)
    if not toxic or not clean:
        return none
    near = docs.sparkSession.createDataFrame(chosen.toArrow(), schema=chosen.schema)  # at most 2 * per_class ids: a bounded broadcast
    texts = docs.select(id_col, F.col(text_col).cast("string").alias("__text")).join(F.broadcast(near), id_col)
    texts = texts.groupBy(id_col, "toxic").agg(F.min_by("__text", F.xxhash64("__text")).alias("__text")).select("__text", "toxic")
    found = cut_lineage(texts.mapInArrow(_features, "slots binary, toxic int"))
    counts = found.mapInArrow(_counted, "slot int, toxic long, clean long").groupBy("slot").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    by_class = {r["toxic"]: r["n"] for r in found.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(by_class) < 2:
        return none
    ratio = ratios(cut_lineage(counts), by_class[1], by_class[0])
    telling = ratio != 0

    def narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [s[telling[s]].astype("<i4").tobytes() for s in (np.frombuffer(b.as_py(), "<i4") for b in batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.binary()), batch.column(1)], names=["slots", "toxic"])

    rows = found.mapInArrow(narrowed, "slots binary, toxic int").toArrow().to_pandas()
    return fit(rows.sort_values(["toxic", "slots"], ignore_index=True), ratio)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many toxic and other documents hold each slot."""
    counts = np.zeros((2, 1 << SLOT_BITS), np.int64)
    for batch in batches:
        for slots, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            counts[toxic][np.frombuffer(slots.as_py(), "<i4")] += 1
    seen = np.flatnonzero(counts.sum(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(counts[1][seen]), pa.array(counts[0][seen])], names=["slot", "toxic", "clean"])


def ratios(counts: DataFrame, n_toxic: int, n_clean: int) -> np.ndarray:
    """The log ratio of each slot's smoothed share of toxic documents' slots to its share of the others'.

    Zero but for the TELLING slots whose shares of documents differ by most standard errors, and by more than LEAST_SIGMAS;
    only these reach the driver.
    """
    all_toxic, all_clean = counts.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum("clean"), F.lit(0))).first()
    ratio = F.log((F.col("toxic") + 1.0) / (all_toxic + (1 << SLOT_BITS))) - F.log((F.col("clean") + 1.0) / (all_clean + (1 << SLOT_BITS)))
    share = (F.col("toxic") + F.col("clean")) / float(n_toxic + n_clean)
    error = F.lit(1e-12) + F.sqrt(share * (1 - share) * (1 / n_toxic + 1 / n_clean))
    apart = F.abs(F.col("toxic") / float(n_toxic) - F.col("clean") / float(n_clean)) / error
    beyond = counts.select("slot", ratio.alias("ratio"), apart.alias("apart")).where(F.col("apart") > LEAST_SIGMAS)
    beyond = beyond.orderBy(F.desc("apart"), "slot").limit(TELLING).toArrow()
    out = np.zeros(1 << SLOT_BITS)
    out[beyond.column("slot").to_numpy()] = beyond.column("ratio").to_numpy()
    return out


def fit(found: pd.DataFrame, ratio: np.ndarray, rounds: int = 120, penalty: float = PENALTY) -> Model:
    """Logistic regression on presence times ratio, by full-batch Adam; classes weigh the same."""
    slots = [np.frombuffer(s, "<i4") for s in found["slots"]]
    y = found["toxic"].to_numpy(np.float64)
    rows = np.repeat(np.arange(len(y)), [len(s) for s in slots])
    cols = np.concatenate(slots)
    kept = np.flatnonzero(ratio)
    values, cols, n = ratio[cols], np.searchsorted(kept, cols), len(kept)
    weigh = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    w, b = np.zeros(n), 0.0
    m, v, mb, vb = np.zeros(n), np.zeros(n), 0.0, 0.0
    for step in range(1, rounds + 1):
        z = np.bincount(rows, weights=values * w[cols], minlength=len(y)) + b
        off = weigh * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        g = np.bincount(cols, weights=values * off[rows], minlength=n) + penalty * w
        gb = off.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = 0.03 / (1 - 0.9**step) * np.sqrt(1 - 0.999**step)
        w -= rate * m / (np.sqrt(v) + 1e-8)
        b -= rate * mb / (np.sqrt(vb) + 1e-8)
    weights = np.zeros(1 << SLOT_BITS, np.float32)
    weights[kept] = w * ratio[kept]
    return Model(weights, float(b))


def _scores(texts: pa.Array, model: Model) -> np.ndarray:
    data, offsets = padded(texts)
    heavy = model.weights != 0
    found = []
    for length, slots in zip(LENGTHS, grams(data), strict=True):
        at = np.flatnonzero(heavy[slots])
        row = np.searchsorted(offsets, at, side="right") - 1
        own = at + length <= offsets[row + 1]  # n-grams do not run into the next text
        found.append(row[own] << SLOT_BITS | slots[at[own]])
    pairs = np.unique(np.concatenate(found))  # presence: once for each text
    weights = model.weights[pairs & (1 << SLOT_BITS) - 1]
    total = np.bincount(pairs >> SLOT_BITS, weights=weights, minlength=len(offsets) - 1) + model.intercept
    return np.round(1 / (1 + np.exp(-np.clip(total, -40, 40))), DIGITS)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, 1):
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(_scores(block.column(1), model))], names=[id_col, "score"])

    return docs.select(id_col, F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"`{id_col}` {id_type}, score double")


def reject(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, that score below the threshold."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, at):
            yield block.filter(pa.array(_scores(block.column(at), model) < threshold))

    return docs.mapInArrow(run, docs.schema)
