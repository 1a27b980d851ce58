from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from palimpsest.llm import toxicity as t


def tables(spark, docs):
    bad = ["you utter grobnik, go away", "what a Grobnik thing", "grobnik! grobnik!", "he is such a grobnik today"]
    good = ["a quiet day by the lake", "the train was late again", "soup with bread and salt", "we read about stars"]
    texts = (bad + good) * 8 + [None, "", "no label here, grobnik", "plain and calm"]
    table = docs([x and f"{x} {k}" for k, x in enumerate(texts)])
    labels = [(k, int(k % 8 < 4)) for k in range(64)] + [(0, 0), (None, 1), (64, None)]
    return table, spark.createDataFrame(labels, "doc_id long, toxic int")


def test_learns_and_scores(spark, docs):
    table, labels = tables(spark, docs)
    learn = F.crc32(F.col("doc_id").cast("string")) % 3 != 1
    model = t.train(table, labels, learn)
    got = {r.doc_id: r.score for r in t.score(table, model).collect()}
    assert len(got) == 68 and all(0 <= s <= 1 for s in got.values())
    assert all((got[k] >= t.THRESHOLD) == (k % 8 < 4) for k in range(64))
    assert got[66] >= t.THRESHOLD > got[67] and got[64] == got[65] < t.THRESHOLD
    kept = t.reject(table, model)
    assert kept.columns == table.columns and 66 not in {r.doc_id for r in kept.collect()}


def test_nothing_to_learn_and_empty_tables(spark, docs):
    table, labels = tables(spark, docs)
    for some in (labels.where("toxic = 1"), labels.limit(0)):
        scores = {r.score for r in t.score(table, t.train(table, some, F.lit(True))).collect()}
        assert len(scores) == 1
    model = t.train(docs([]), labels, F.lit(True))
    assert t.score(docs([]), model).count() == 0


def test_scores_match_a_plain_version(spark, docs):
    table, labels = tables(spark, docs)
    model = t.train(table, labels, F.lit(True))
    assert 0 < (model.weights != 0).sum() <= t.TELLING
    for row in t.score(table, model).join(table.select("doc_id", "text"), "doc_id").collect():
        folded = "".join(c.lower() if c.isalnum() else " " for c in row.text or "").encode()
        line = b" " + folded + b" "
        held = set()
        for length in t.LENGTHS:
            for k in range(len(line) - length + 1):
                key = (int.from_bytes(line[k : k + length], "big") + length) & (1 << 64) - 1
                held.add(int(t.mix64(np.array([key], np.uint64))[0]) >> 64 - t.SLOT_BITS)
        total = model.intercept + sum(float(model.weights[s]) for s in held)
        assert abs(row.score - 1 / (1 + np.exp(-total))) < 1e-6


def test_repeats_long_texts_clashing_columns_and_partitions(spark, docs):
    table, labels = tables(spark, docs)
    odd = table.withColumn("score", F.lit("x")).withColumn("slots", F.lit("y")).withColumn("toxic", F.lit("z"))
    odd = odd.unionByName(spark.createDataFrame([(0, "you utter grobnik, go away 0", "x", "y", "z")] * 500 + [(900, "calm words " * 300_000 + "grobnik", "x", "y", "z")], "doc_id long, text string, score string, slots string, toxic string"), allowMissingColumns=True)
    found = [t.score(odd.repartition(n), t.train(odd.repartition(n), labels, F.lit(True))).distinct() for n in (1, 7)]
    one, two = ({r.doc_id: r.score for r in f.collect()} for f in found)
    assert one == two and one[900] >= 0.5
    assert "toxic" in t.reject(odd, t.train(odd, labels, F.lit(True))).columns
