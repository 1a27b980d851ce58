from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.llm import perplexity as p
from palimpsest.llm.common import RollingHash


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    triples = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {j for k in range(len(words) - 2) if triples[tuple(words[k : k + 3])] > 1 for j in range(k, k + 3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.none() | st.text(alphabet="ab#\n \té| ", max_size=40), min_size=1, max_size=6))
def test_base_counts(texts):
    got = p.base_counts(pa.array(texts, pa.string()), RollingHash())
    assert np.array(got).T.tolist() == [base(t) for t in texts]


def kneser_ney(texts, alphabet):
    """Plain interpolated modified Kneser-Ney of order 6: p(context, symbol) from lists of code points."""
    lines = [[p.BEGIN] * 5 + [ord(c) for c in t.lower()] + [p.END] for t in texts if t]
    grams = Counter(tuple(line[k - 5 : k + 1]) for line in lines for k in range(5, len(line)))
    by_order = {6: grams}
    for order in range(5, 0, -1):
        by_order[order] = Counter(g[1:] for g in by_order[order + 1])
    discounts = {k: p._discounts(tuple(sum(n == j for n in c.values()) for j in (1, 2, 3, 4))) for k, c in by_order.items()}

    def off(order, n):
        return discounts[order][min(n, 3) - 1]

    def prob(gram):
        order = len(gram)
        below = prob(gram[1:]) if order > 1 else 1 / len(alphabet)
        after = {g: n for g, n in by_order[order].items() if g[:-1] == gram[:-1]}
        total = sum(after.values())
        if not total:
            return below
        own = after.get(gram, 0)
        return (own - off(order, own) if own else 0) / total + sum(off(order, n) for n in after.values()) / total * below

    return prob


def test_log_perplexities_match_plain_kneser_ney(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice("abé я") for _ in range(rng.randint(1, 40))) for _ in range(30)] + ["", None, "Same text", "Same text", "İx"]
    table = spark.createDataFrame([(k, t, None, "x") for k, t in enumerate(texts)], "doc_id long, text string, lang string, fold string").repartition(3)
    table = p.written(table, "texts")
    fold = {r.doc_id: r.f for r in table.select("doc_id", F.pmod(F.xxhash64("text"), F.lit(2)).alias("f")).collect()}
    got = {r.doc_id: r.log_perplexity for r in p.measured(table).collect()}
    alphabet = {ord(c) for t in texts if t for c in t.lower()} | {p.END}
    models = [kneser_ney([t for k, t in enumerate(texts) if fold[k] == f], alphabet) for f in (0, 1)]
    for k, text in enumerate(texts):
        if not text:
            assert got[k] is None
            continue
        line = [p.BEGIN] * 5 + [ord(c) for c in text.lower()] + [p.END]
        bits = [-np.log2(models[1 - fold[k]](tuple(line[j - 5 : j + 1]))) for j in range(5, len(line))]
        assert abs(got[k] - sum(bits) / len(bits)) < 0.01


def test_hash_arrays_hold_probabilities_that_sum_to_one():
    rng = np.random.default_rng(0)
    text = "".join("abc"[k] for k in rng.integers(0, 3, 3000))
    block = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["en"]), pa.array([0], pa.int32()), pa.array([text])], names=["__id", "lang", "fold", "__text"])
    grams = p.sorted_by_points(p.merged(p.counted(block)))
    types = p.levels(grams)
    discounts = {(o, m): p._discounts(tuple(int((c == k).sum()) for k in (1, 2, 3, 4))) for m in (0, 1) for o, c in p.counts_by_order(grams.n[m], types).items()}
    pairs = [(a, b, 0.25, 0.25) for a in (1, 97, 98, 99) for b in (2, 97, 98, 99)]
    high, low = (np.array([97 << 42 | 98 << 21 | 99], np.uint64), np.array([97 << 42 | 98 << 21 | b for b in (2, 97, 98, 99)], np.uint64))
    every = p.sorted_by_points(p.merged([grams, p.Grams(np.repeat(high, 4), low, [np.zeros(4, np.int64)] * 2)]))
    keys, values = p.hash_array(every, pairs, discounts)
    at = np.searchsorted(keys, p.hashes(np.repeat(high, 4), low))
    assert abs((2.0 ** (values[0][at] / p.STEPS)).sum() - 1) < 0.01
    assert (np.diff(keys.astype(object)) > 0).all()


def test_packed_ngrams_come_back():
    grams = p.merged([p.Grams(np.array([0x10FFFF << 42 | 5, 7], np.uint64), np.array([1 << 42 | 0x10FFFF, 9], np.uint64), [np.array([3, 0]), np.array([0, 70_000])])] * 2)
    back = p.unpacked(p.packed(grams))
    assert all((a == b).all() for a, b in zip((grams.high, grams.low, *grams.n), (back.high, back.low, *back.n), strict=True)) and grams.n[0].max() == 6


def test_gibberish_is_outside_its_band(spark):
    rng = random.Random(1)
    vocabulary = ["the", "river", "stone", "walks", "under", "green", "light", "again"]
    say = lambda: " ".join(rng.choice(vocabulary) for _ in range(80))
    junk = " ".join("".join(rng.choice("qxzjkvwy#0189") for _ in range(7)) for _ in range(80))
    rows = [(k, say(), "en") for k in range(60)] + [(100, junk, "en"), (101, None, "en"), (102, "", None), (103, say(), None)]
    got = {r.doc_id: r for r in p.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert len(got) == len(rows)
    assert all(got[k].kept for k in range(60) if not got[k].base_failed)
    assert not got[100].kept and not got[100].base_failed
    assert got[101].base_failed and got[102].base_failed and not got[102].kept


def test_empty_table(spark):
    assert p.judged(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def test_order_and_letters_of_any_script_count(spark):
    rng = random.Random(2)
    names = {"en": [f"{a}{b}" for a in "bdgkm" for b in ("an", "el", "ost", "urn")], "ru": [f"{a}{b}" for a in "бдгкм" for b in ("ан", "ел", "ост", "урн")]}
    rows = []
    for lang, words in names.items():
        after = {w: rng.sample(words, 2) for w in words}
        for k in range(120):
            said = [rng.choice(words)]
            while len(said) < 100:
                said.append(rng.choice(after[said[-1]]))
            mixed = rng.sample(said, len(said))
            letters = ["".join(rng.sample(w, len(w))) for w in said]
            kind, said = {118: ("mixed", mixed), 119: ("letters", letters)}.get(k, ("real", said))
            rows.append((f"{lang} {kind} {k}", " ".join(said), lang))
    got = {r.doc_id: r for r in p.measured(spark.createDataFrame(rows, "doc_id string, text string, lang string")).collect()}
    for lang in names:
        real = max(r.log_perplexity for k, r in got.items() if k.startswith(f"{lang} real"))
        assert got[f"{lang} mixed 118"].log_perplexity > real + 0.5
        assert got[f"{lang} letters 119"].log_perplexity > real + 0.5


def test_chunks_and_buckets_change_nothing(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice(["sun", "moon", "tide", "sand"]) for _ in range(60)), rng.choice(["en", "de", None]), "a", "b", 1) for k in range(40)]
    rows += [(0, rows[0][1], "en", "a", "b", 1)] * 3 + [(99, "long text " * 200_000, "en", "a", "b", 1)]
    table = p.written(spark.createDataFrame(rows, "doc_id long, text string, lang string, bucket string, chunk string, row int").repartition(2), "texts")
    found = []
    for chunk in (p.CHUNK, 3000):
        monkeypatch.setattr(p, "CHUNK", chunk)
        found.append(sorted((r.doc_id, r.lang, r.n_words, r.log_perplexity) for r in p.measured(table).collect()))
    assert found[0] == found[1] and len(found[0]) == len(rows)


def test_bands_have_no_floor_and_follow_the_labels(spark):
    flat = [(k, "flat", False, 2.0) for k in range(40)] + [(40, "flat", False, 2.1)]
    wide = [(100 + k, "wide", False, 5 + 0.01 * (k % 21 - 10)) for k in range(210)]
    bad = [(400 + k, "wide", False, 5.16) for k in range(30)]
    rows = spark.createDataFrame(flat + wide + bad, "doc_id long, lang string, base_failed boolean, log_perplexity double")
    labels = spark.createDataFrame([(r[0], 1) for r in wide] + [(r[0], 0) for r in bad], "doc_id long, quality int")
    kept = {r.doc_id: r.kept for r in p.banded(rows, labels).collect()}
    assert [k for k, v in sorted(kept.items()) if not v] == [40] + [r[0] for r in bad]
    assert [r.doc_id for r in p.banded(rows).where("not kept").collect()] == [40]
