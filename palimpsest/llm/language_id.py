"""Language identification by string kernels with Nystroem landmarks and kernel ridge regression.

The kernel of two texts is the share of n-grams that both hold, of all lengths together (a blended
spectrum of presences): k(x, y) = |S(x) & S(y)| / sqrt(|S(x)| |S(y)|), with n-grams hashed to
2 to the SLOT_BITS slots. Some training texts of each language are landmarks; kernels with them,
whitened, are the features of a ridge regression of each language against the rest. Both steps are
linear in the presences, so the model is one weight for each slot of a landmark and language, and
scoring sums the weights of the slots that a text holds. The model's size is bounded by the
parameters and the number of languages.

A text is scored in stretches of at most STRETCH bytes, and its values are the mean of theirs by length:
presences of a long text would fill up, until it held the n-grams of every language.

Training takes about `per_language` texts of each language, drawn by a hash of the id. Tasks compute their kernels with the
landmarks and add up the sums of products that the regression needs; the driver holds the landmarks, at most MOST_LANDMARKS
or LEAST_LANDMARKS a language, and those sums.

Edge cases: a null text, or one without a letter, is `und` with score 0; a very long text is scored stretch by stretch; with
nothing to learn from every text is `und`; rows that repeat are scored alike; ties go to the language that sorts first;
an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import blocks, cut_lineage, mix64, separated

LENGTHS = (2, 3, 4)
SLOT_BITS = 18
SLOTS = 1 << SLOT_BITS
#: Training texts and landmarks of each language; landmarks of all languages at most, but so many of each at least.
PER_LANGUAGE = 400
LANDMARKS = 24
MOST_LANDMARKS, LEAST_LANDMARKS = 512, 4
#: Tasks that add up the sums of products.
SUMMED = 8
PENALTY = 1e-2
#: Bytes of a text that are scored together, and bytes of text that a task works on at once.
STRETCH = 1 << 13
BLOCK = 1 << 20
UNKNOWN = "und"

#: ASCII letters lower-cased, other ASCII characters as spaces, so case, digits and marks do not count.
FOLDED = np.array([b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalpha() else 32 for b in range(256)], np.uint8)


class Model(NamedTuple):
    languages: list[str]
    slots: np.ndarray  # of all landmarks, sorted
    weights: np.ndarray  # slots by languages


def presences(texts: pa.Array, stretch: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The text and the length of each stretch; and the stretches and slots that go together, in order. A text is
    one stretch if no length is given; an n-gram belongs to the stretch that it starts in."""
    data, offsets = separated(texts)
    folded, n = FOLDED[data].astype(np.uint64), len(offsets) - 1
    size = np.diff(offsets)
    pieces = np.ones(n, np.int64) if stretch is None else -(-size // stretch)
    row = np.repeat(np.arange(n), size)
    piece = row if stretch is None else (np.cumsum(pieces) - pieces)[row] + (np.arange(len(data)) - offsets[row]) // stretch
    found = []
    for length in LENGTHS:
        m = len(folded) - length + 1
        if m <= 0:
            continue
        key = np.zeros(m, np.uint64)
        for k in range(length):
            key = key << np.uint64(8) | folded[k : m + k]
        slot = (mix64(key + np.uint64(length << 40)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        own = row[:m] == row[length - 1 :]
        found.append((piece[:m] << SLOT_BITS | slot)[own])
    both = np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)
    both = both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both
    return np.repeat(np.arange(n), pieces), np.bincount(piece, minlength=pieces.sum()), both >> SLOT_BITS, both & (SLOTS - 1)


def _weighed(slot: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of `slot` are among the sorted `slots`, and where these stand."""
    at = np.minimum(np.searchsorted(slots, slot), len(slots) - 1)
    known = slots[at] == slot
    return known, at[known]


def values(texts: pa.Array, model: Model) -> np.ndarray:
    """The regression's values, texts by languages."""
    text, length, piece, slot = presences(texts, STRETCH)
    held = np.sqrt(np.maximum(1, np.bincount(piece, minlength=len(text))))
    known, at = _weighed(slot, model.slots)
    share = length / held / np.bincount(text, weights=length, minlength=len(texts))[text]
    of, share = text[piece[known]], share[piece[known]]
    return np.stack([np.bincount(of, weights=w[at] * share, minlength=len(texts)) for w in model.weights.T], axis=1)


def _has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, 0, BLOCK):
        text, _, piece, slot = presences(block.column(0))
        found = [p.astype("<i4").tobytes() for p in np.split(slot, np.searchsorted(piece, np.arange(1, len(text))))]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), block.column(1), block.column(2)], names=["slots", "lang", "drawn"])


def train(docs: DataFrame, learn_from: Column, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fits the model on about `per_language` texts of each language."""
    known = docs.where(learn_from & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy(lang_col).count().collect()}
    if not counts:
        return Model([], np.zeros(0, np.int64), np.zeros((0, 0)))
    drawn = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30))
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, int(min(1.0, per_language / n) * (1 << 30)))])
    some = known.where(drawn < share[F.col(lang_col)])
    rows = some.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang"), drawn.alias("drawn"))
    held = cut_lineage(rows.mapInArrow(_features, "slots binary, lang string, drawn long"))
    each = min(LANDMARKS, max(LEAST_LANDMARKS, MOST_LANDMARKS // len(counts)))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("drawn", "slots"))
    marks = held.withColumn("nth", nth).where(F.col("nth") <= each).select("slots", "lang", "drawn").toArrow().to_pandas()
    return fit(held, marks.sort_values(["lang", "drawn", "slots"], ignore_index=True))


class Landmarks:
    """Which landmarks hold each slot, and how much each one's slots weigh."""

    def __init__(self, slots: list[np.ndarray]) -> None:
        self.n = len(slots)
        self.scale = np.array([1 / np.sqrt(max(1, len(s))) for s in slots])
        slot, mark = np.concatenate(slots), np.repeat(np.arange(self.n), [len(s) for s in slots])
        by = np.argsort(slot, kind="stable")
        self.mark = mark[by].astype(np.int32)
        self.start = np.searchsorted(slot[by], np.arange(SLOTS + 1))

    def kernels(self, slots: np.ndarray) -> np.ndarray:
        """The kernel of a text with every landmark."""
        first, size = self.start[slots], self.start[slots + 1] - self.start[slots]
        at = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
        return np.bincount(self.mark[at], minlength=self.n) * self.scale / np.sqrt(max(1, len(slots)))


def _slots(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<i4").astype(np.int64)


def fit(held: DataFrame, marks: pd.DataFrame) -> Model:
    """The model from training rows (slots, lang, drawn) and the landmarks among them."""
    own = [_slots(raw) for raw in marks["slots"]]
    if not sum(map(len, own)):
        return Model([], np.zeros(0, np.int64), np.zeros((0, 0)))
    landmarks = Landmarks(own)
    among = np.stack([landmarks.kernels(s) for s in own])
    spread, vectors = np.linalg.eigh((among + among.T) / 2)
    kept = spread > 1e-6 * spread.max()
    whiten = vectors[:, kept] / np.sqrt(spread[kept])
    sent = held.sparkSession.sparkContext.broadcast((landmarks, whiten))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of products of the features, and sums of them and rows by language."""
        near, white = sent.value
        gram, sums = np.zeros((white.shape[1],) * 2), {}
        for batch in batches:
            features = np.stack([near.kernels(_slots(raw)) for raw in batch.column(0).to_pylist()]) @ white
            gram += features.T @ features
            langs = np.array(batch.column(1).to_pylist(), object)
            for lang in sorted(set(langs)):
                total, n = sums.get(lang, (0, 0))
                sums[lang] = total + features[langs == lang].sum(axis=0), n + int((langs == lang).sum())
        rows = [(None, gram.tobytes(), 0), *((lang, total.tobytes(), n) for lang, (total, n) in sums.items())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.binary(), pa.int64()), strict=True)], names=["lang", "sums", "n"])

    parts = held.repartition(SUMMED, "drawn").sortWithinPartitions("drawn", "lang", "slots").mapInArrow(run, "lang string, sums binary, n long")
    parts = parts.toArrow().to_pylist()  # SUMMED tasks' sums
    read = lambda raw: np.frombuffer(raw, np.float64)
    gram = sum(read(p["sums"]) for p in parts if p["lang"] is None).reshape((kept.sum(),) * 2)
    languages = sorted({p["lang"] for p in parts if p["lang"] is not None})
    wanted = np.stack([sum(read(p["sums"]) for p in parts if p["lang"] == lang) for lang in languages], axis=1)
    gram = gram + PENALTY * sum(p["n"] for p in parts) / landmarks.n * np.eye(len(gram))
    alpha = whiten @ np.linalg.solve(gram, wanted) * landmarks.scale[:, None]
    slots = np.unique(np.concatenate(own))
    weights = np.zeros((len(slots), len(languages)))
    for mark, row in zip(own, alpha, strict=True):
        weights[np.searchsorted(slots, mark)] += row
    return Model(languages, slots, weights)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for every row; the score is the regression's value, kept within 0 and 1."""
    id_type = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages = sent.value.languages
        for block in blocks(batches, 1, BLOCK):
            texts = block.column(1)
            letters = np.array([_has_letter(t.as_py()) for t in texts])
            if not languages:
                best, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            else:
                found = values(texts, sent.value)
                top = found.argmax(axis=1)
                best = np.where(letters, np.array(languages, object)[top], UNKNOWN)
                score = np.where(letters, np.clip(found[np.arange(len(top)), top], 0, 1), 0).round(5)  # sums differ in the last digits with the batch
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(best, pa.string()), pa.array(score, pa.float64())], names=[id_col, "lang_pred", "score"])

    return docs.select(id_col, F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"`{id_col}` {id_type}, lang_pred string, score double")
