from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from palimpsest.llm import language_id as li
from palimpsest.llm.queries import op7_language_id

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    lang = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    row = op7_language_id(spark, SF).join(lang, "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.min("score"), F.max("score")).first()
    assert row[0] > 0.97 and row[1] >= 0 and row[2] <= 1


def test_odd_texts_and_nothing_to_learn(docs):
    table = docs(["some words here", None, "", "12 34 !!", "some words here", "w" * 50_000])
    model = li.train(table, F.lit(True))
    got = {r.doc_id: (r.lang_pred, r.score) for r in li.predict(table, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[0] == got[4] and got[0][0] == "en"
    assert li.predict(docs([]), model).count() == 0
    nothing = li.train(table, F.lit(False))
    assert {r.lang_pred for r in li.predict(table, nothing).collect()} == {"und"}


def test_long_texts_of_rich_vocabulary(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = li.train(table, ~held_out)
    rng, words = random.Random(3), {}
    for r in table.where(held_out & F.col("text").isNotNull()).select("lang", "text").collect():
        words.setdefault(r.lang, []).extend(r.text.split())
    junk = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8))
    rows = []
    for lang, held in sorted(words.items()):
        for size, share in ((1_000_000, 0.02), (100_000, 0.1), (3_000_000, 0.1)):
            said, n = [], 0
            while n < size:
                said.append(junk() if rng.random() < share else rng.choice(held))
                n += len(said[-1]) + 1
            rows.append((lang, " ".join(said)))
    found = li.predict(spark.createDataFrame(rows, "doc_id string, text string"), model).collect()
    assert len(rows) == 12 and [r.lang_pred for r in found] == [r.doc_id for r in found] and min(r.score for r in found) > 0.3


def test_kernels_and_regression_match_a_dense_version(spark):
    texts = {"en": ["the old house stood there", "this thing with that", "when they went home"], "de": ["der alte mann und das haus", "die frau schreibt nicht", "ich gehe nach hause"]}
    rows = [(k, t, lang) for lang, own in texts.items() for k, t in enumerate(own * 4, 100 * len(lang) + ord(lang[0]))]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = li.train(table, F.lit(True), per_language=1000)
    held = {t: set(li.presences(pa.array([t]))[3].tolist()) for own in texts.values() for t in own}
    kernel = lambda a, b: len(held[a] & held[b]) / np.sqrt(len(held[a]) * len(held[b]))
    every = [(t, lang) for _, t, lang in rows]
    among = np.array([[kernel(a, b) for b, _ in every] for a, _ in every])  # all texts are landmarks
    spread, vectors = np.linalg.eigh(among)
    kept = spread > 1e-6 * spread.max()
    features = among @ (vectors[:, kept] / np.sqrt(spread[kept]))
    wanted = np.array([[lang == x for x in ("de", "en")] for _, lang in every], float)
    beta = np.linalg.solve(features.T @ features + li.PENALTY * np.eye(kept.sum()), features.T @ wanted)
    got = li.values(pa.array([t for t, _ in every]), model)
    assert np.abs(got - features @ beta).max() < 1e-6


def test_ties_and_clashing_columns(spark):
    rows = [(1, "same words", "fr", "a", "b"), (2, "same words", "de", "a", "b"), (3, "same words", None, "a", "b")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, slots string, score string")
    assert {r.lang_pred for r in li.predict(table, li.train(table, F.lit(True))).collect()} == {"de"}
