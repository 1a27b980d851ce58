from __future__ import annotations

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import html_extraction as h
from palimpsest.llm.html_extraction import extract, main_text

ARTICLE = "<article><h1>A title &amp; more</h1><p>First  paragraph,\nwith <b>bold</b> words and some length to it.</p><p>Second one, longer than the first, which has commas, and ends here.<br>And goes on.</p><p>Short.</p></article>"
WANT = "A title & more\nFirst paragraph, with bold words and some length to it.\nSecond one, longer than the first, which has commas, and ends here. And goes on.\nShort."


def page(before="", after="", article=ARTICLE):
    return f'<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>{before}{article}{after}</body></html>'


def test_article_without_its_surroundings():
    before = '<header><div>Site name</div></header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- ad --><div class="ad">Buy this fine thing now, really.</div><div id="cookie-notice">We use cookies, as all do, for your comfort, always.</div>'
    after = '<aside>Read more, of the same.</aside><section class="comments"><p>I liked it, very much, it was a fine read, thank you.</p></section><form><label>Mail</label></form><footer>&copy; someone</footer>'
    assert main_text(page(before, after)) == WANT


def test_tags_left_open():
    article = "<article><h1>Head</h1><p><b>Bold start, of a text.<br><p>Next paragraph, which is rather long, and goes on.<p>Third.</article>"
    assert main_text(page(article=article)) == "Head\nBold start, of a text.\nNext paragraph, which is rather long, and goes on.\nThird."
    assert main_text(page().replace("</body></html>", "")) == WANT


def test_link_lists_without_names_are_not_content():
    links = "<div><ul>" + "".join(f'<li><a href="/{k}">Link number {k}</a></li>' for k in range(20)) + "</ul></div>"
    assert main_text(page(links, links, ARTICLE.replace("article", "div"))) == WANT


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, "u", "<<<>"), (4, None, "plain text, no tags"), (5, "u", page()), (5, "u", page()), (6, "u", "<p>" * 3000 + "deep"), (7, "u", page(article="<p>" + "word, " * 50_000 + "</p>"))]
    table = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = extract(table).collect()
    by = {r.page_id: r.text for r in got}
    assert len(got) == 8 and by[1] == by[2] == "" and by[4] == "plain text, no tags" and by[5] == WANT and by[6] == "deep"
    assert len(by[7]) == 6 * 50_000 - 1


def test_a_threshold_that_is_broken_changes_the_text(monkeypatch):
    whole = page('<div class="ad">Buy this, now.</div><div>Some short line.</div>')
    assert main_text(whole) == WANT
    monkeypatch.setattr(h, "THRESHOLD", -1e9)
    assert main_text(whole) == "Buy this, now.\nSome short line.\n" + WANT
    monkeypatch.setattr(h, "THRESHOLD", 1e9)
    assert main_text(whole) == ""


def test_ratios_decide_where_names_do_not():
    body = ARTICLE.replace("article>", "div>")
    comments = "<ul>" + "<li><p>I liked it.</p></li>" * 6 + "</ul>"
    assert main_text(page("<div>Login here</div>", comments, body)) == WANT
    assert main_text(page(after=comments)) == WANT
    assert main_text(page("<div>Login here</div>", "", f'<div class="social">{body}</div>')) == WANT
    assert main_text(page(article="<form>" + ARTICLE.replace("</article>", "<ul><li>one thing<li>and another</ul></article>") + "</form>")) == WANT + "\none thing\nand another"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["p", "div", "li", "h2", "td"]), st.sampled_from(["", ' class="x"', ' class="x y"', ' class="ad"']), st.text("ab, .", max_size=60), st.booleans()), max_size=12))
def test_scores_match_a_plain_version(parts):
    inner = "".join(f"<section><{t}{c}>" + (f"<a href=x>{x}</a>" if link else x) + f"</{t}></section>" for t, c, x, link in parts)
    found = h.parse(f"<html><body>{inner}</body></html>")
    rows = [(t + (".ad" if "ad" in c else ".x" if "x" in c else ""), " ".join(x.split()), link) for t, c, x, link in parts if x.strip()]
    assert [b.text for b in found.blocks] == [r[1] for r in rows]
    if not rows:
        return
    by = {}
    for p, x, link in rows:
        by.setdefault(p, []).append((len(x), sum(x.count(m) for m in ",."), len(x) if link else 0))
    ratio = [[sum(v[k] for v in by[p]) / len(by[p]) for k in (0, 1)] for p, _, _ in rows]
    lengths, marks = [r[0] for r in ratio], [r[1] + 0.1 / len(by[p]) for r, (p, _, _) in zip(ratio, rows, strict=True)]
    near = lambda v, k: (v[max(k - 1, 0)] + 2 * v[k] + v[min(k + 1, len(v) - 1)]) / 4
    unlinked = {p: sum(v[0] - v[2] for v in own) for p, own in by.items()}
    every = sum(unlinked.values())
    score = []
    for k, (p, _, _) in enumerate(rows):
        share = unlinked[p] / sum(v[0] for v in by[p])
        name = 0.01 if p.endswith(".ad") and 2 * unlinked[p] <= every else 1
        score.append(near(lengths, k) * near(marks, k) * share * name)
    mean = {p: sum(s for s, r in zip(score, rows, strict=True) if r[0] == p) / len(by[p]) for p in by}
    got = h.scored(found)
    labels = [f"{p}" for p, _, _ in rows]
    assert all(abs(got.score[b.path] - mean[p]) < 1e-6 * (1 + mean[p]) for b, p in zip(found.blocks, labels, strict=True))
    middle = sum(score) / len(score)
    assert abs(got.spread - (sum((s - middle) ** 2 for s in score) / len(score)) ** 0.5) < 1e-6 * (1 + middle)


@pytest.mark.parametrize("hostile", ["<a \"" * 250_000, "<a \">\" " * 140_000, "<div>" * 100_000 + "x" + "</div>" * 100_000, "<!--" * 250_000, "<b>" * 100_000 + "<i>" * 100_000 + "</b>" * 100_000, "<script " * 120_000, "</x>" * 250_000, "<p>a" * 250_000, "&amp" * 250_000])
def test_hostile_pages_take_linear_time(hostile):
    began = time.process_time()
    main_text(hostile)
    assert time.process_time() - began < 6
