from __future__ import annotations

import os
import sys
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from palimpsest.llm import queries
from palimpsest.llm.common import written

sys.path.insert(0, os.path.dirname(__file__))
from test_decontamination import brute as contaminations
from test_simhash import groups, slow_fingerprint

SF = "/root/testdata/sf0.001"


def test_stages_keep_their_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == columns
        kept = written(kept, name)
        now = {r.doc_id for r in kept.select("doc_id").collect()}
        assert now <= before
        if name == "suffix_array":
            assert now == before
        docs, before = kept, now
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in last.collect()} == before and "n_tokens" in last.columns


def test_copies_leave_one_row_and_other_texts_stay(spark):
    rows = [(1, "one text of five words"), (1, "one text of five words"), (2, "one text of five words"), (None, "something else entirely here"), (None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id or 0) for r in corpus_pipeline.keep_one_of_each(spark, table, SF).collect()) == [0, 0, 1]


def test_one_row_of_each_group_stays_whatever_its_id(spark):
    one, two, three = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(None, one), (None, two), (None, two), (5, three), (5, one), (3, three), (3, "quite another text of some words"), (None, None)]
    got = corpus_pipeline.keep_one_of_each(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    want = [(5, one), (None, two), (3, three), (3, "quite another text of some words"), (None, None)]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def odd_documents(spark):
    """Nulls everywhere, empty and very long texts, repeats, and columns whose names the stages use themselves."""
    base = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    long = "unusual sentence number one " * 100_000
    rows = [(None, None, None, None, None), (900001, "", "en", "s", 0), (900002, "", "en", "s", 0), (900003, long, None, None, None), (None, "short", "en", "s", 5), (None, "short", "en", "s", 5), (900004, "short", None, "s", 5)]
    odd = base.unionByName(spark.createDataFrame(rows, base.schema))
    clash = ["__rid", "__row", "__text", "spans", "score", "toxic", "fp", "component", "runs", "items", "n_tokens", "ids"]
    return odd.select("*", *[F.lit(name).alias(name) for name in clash if not name.startswith("__")])


def test_stages_take_odd_documents(spark):
    docs = odd_documents(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = written(stage(spark, docs, SF), name)
        assert docs.columns == columns
    left = docs.select("doc_id", "text").collect()
    assert sum(r.text == "short" for r in left) == 1 and any(r.doc_id == 900003 for r in left)
    assert sum(not r.text and r.doc_id not in (900003,) for r in left if r.doc_id is None or r.doc_id > 900000) == 1
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == len(left)


def test_stages_take_empty_tables(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_matches_stages_of_plain_python(spark):
    """Groups, cuts and windows again by brute force; the classifier and the codec have peers of their own in other tests."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.reject_toxic(spark, docs, SF)
    rows = [(r.doc_id, r.text) for r in kept.select("doc_id", "text").collect()]
    prints = [slow_fingerprint(t) for _, t in rows]
    linked = {}
    for group in groups(sorted(set(prints)), 4):
        for v in group:
            linked[v] = min(group)
    first = {}
    for (doc_id, text), v in zip(rows, prints, strict=True):
        first.setdefault(linked.get(v, v), []).append((doc_id, text))
    rows = [min(own) for own in first.values()]
    cut = cuts([t for _, t in rows])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {doc_id for (doc_id, _), (_, hit, _) in zip(rows, contaminations(cut, items), strict=True) if not hit}
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == want


def cuts(texts):
    raw = [(t or "").encode() for t in texts]
    times = Counter(b[k : k + 200] for b in raw for k in range(len(b) - 199))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - 199):
            if times[b[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        out.append(bytes(c for c, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore"))
    return out


def test_every_operator_has_one_query():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{k}" for k in range(1, 11)]
    assert set(queries.oracle_sql()) <= set(queries.queries())
