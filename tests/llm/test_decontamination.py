from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import decontamination as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(texts, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - 9)) if w else ():
            windows.setdefault(tuple(w[k : k + 10]), set()).add("" if item is None else str(item))
    out = []
    for text in texts:
        w, hit, found = words(text), set(), set()
        for win, owners in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    found |= owners
        out.append((len(w), len(hit), sorted(found)))
    return out


@pytest.fixture(scope="module")
def case():
    rng = random.Random(2)
    say = lambda n: " ".join(rng.choice(["Ab", "b", "ç", "dd", "e1"]) for _ in range(n))
    items = [(1, say(14)), (2, say(10)), (3, "Only, three words"), (4, ""), (5, None), (None, say(11)), (1, say(12)), (7, "lone")]
    texts = [say(40), None, "", items[0][1], "x " + items[1][1].upper() + "! y", "only THREE... words", "one lone word", say(5000) + " " + items[5][1], "lonely", items[0][1]]
    return texts, items


@pytest.mark.parametrize("portion", [1 << 20, 60])
def test_matches_brute_force(spark, docs, case, portion):
    texts, items = case
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in d.search(docs(texts), bench, item_bytes=portion).collect()}
    want = brute(texts, items)
    assert [(got[k].n_words, got[k].n_hit, sorted(got[k]["items"])) for k in range(len(texts))] == want
    assert all(sum(x.last - x.first + 1 for x in got[k].runs) == want[k][1] for k in got)


def test_clean_documents_stay(spark, docs, case):
    texts, items = case
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = docs(texts).withColumn("rid", F.lit(1)).withColumn("items", F.lit("x")).withColumn("n_hit", F.lit(2))
    for item_bytes in (80, 1 << 20):
        kept = d.keep_clean(table, bench, item_bytes=item_bytes)
        assert kept.columns == table.columns
        assert sorted(r.doc_id for r in kept.collect()) == [k for k, w in enumerate(brute(texts, items)) if not w[1]]


@pytest.mark.parametrize("portion", [1 << 20, 60])
def test_repeated_rows_and_very_long_texts(spark, docs, case, portion):
    texts, items = case
    bench = spark.createDataFrame(items, "item_id long, text string")
    many = [texts[3]] * 50 + ["filler words " * 300_000 + texts[3]]
    got = d.search(docs(many, ids=[None, 7] * 25 + [8]), bench, item_bytes=portion).collect()
    want = brute([texts[3]], items)[0]
    assert len(got) == 51 and {(r.n_words, r.n_hit, tuple(r["items"])) for r in got if r.doc_id != 8} == {(want[0], want[1], tuple(want[2]))}
    assert [r.n_hit for r in got if r.doc_id == 8] == [want[1]]


def test_empty_tables(spark, docs, case):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in d.search(docs(["a b"]), none).collect()] == [0]
    assert d.search(docs([]), spark.createDataFrame(case[1], "item_id long, text string")).count() == 0
