from __future__ import annotations

import gzip
import time

import pytest

from palimpsest.llm import warc


def read_all(archive, step=7):
    return list(warc.Reader(iter([archive[k : k + step] for k in range(0, len(archive), step)])))


def test_round_trip_in_small_chunks():
    archive = warc.member(1, "http://a/\r\nb", b"x" * 5000, None) + warc.member(2, None, b"", None) + warc.member(3, "u", b"x" * 5000, 1)
    found = [warc.verified(r) for r in read_all(archive)]
    assert found == [("response", 5000, b"x" * 5000), ("response", 0, b""), ("revisit", 5000, None)]
    assert gzip.decompress(archive).count(b"WARC/1.1") == 3


@pytest.mark.parametrize("damage", [lambda a: a[:-9], lambda a: gzip.compress(gzip.decompress(a).replace(b"hello", b"jello")), lambda a: gzip.compress(gzip.decompress(a).replace(b"Content-Length: 5\r\n", b"Content-Length: 4\r\n"))])
def test_damage_is_noticed(damage):
    archive = damage(warc.member(1, "u", b"hello", None))
    with pytest.raises(ValueError):
        [warc.verified(r) for r in read_all(archive)]


def test_archives_of_a_table(spark):
    rows = [(1, "a", "same"), (2, "b", "same"), (3, None, None), (4, "d", ""), (5, "e", "é" * 9), (2, "b", "same"), (None, "n", "null id")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(((r.page_id or "", r.record_type, r.payload_bytes, r.refers_to) for r in warc.read(warc.archives(pages)).collect()), key=repr)
    assert got == sorted([("1", "revisit", 4, "2"), ("2", "response", 4, None), ("2", "response", 4, None), ("3", "revisit", 0, "4"), ("4", "response", 0, None), ("5", "response", 18, None), ("", "response", 7, None)], key=repr)
    assert warc.read(warc.archives(pages.limit(0))).count() == 0


def test_an_archive_in_one_chunk_is_read_in_linear_time():
    one = warc.member(1, "u", b"some text, again and again" * 20, None)
    began = time.process_time()
    assert sum(1 for _ in read_all(one * 1000, 1 << 30)) == 1000
    few = time.process_time() - began
    began = time.process_time()
    assert sum(1 for _ in read_all(one * 8000, 1 << 30)) == 8000
    assert time.process_time() - began < 20 * few + 0.5


def test_long_payloads_and_clashing_columns(spark):
    html = "long page " * 500_000
    pages = spark.createDataFrame([(1, "u", html, "a", "b"), (2, "u", html, "a", "b")], "page_id long, url string, html string, digest string, response string")
    got = sorted((r.page_id, r.record_type, r.payload_bytes, r.refers_to) for r in warc.read(warc.archives(pages)).collect())
    assert got == [("1", "revisit", len(html), "2"), ("2", "response", len(html), None)]
