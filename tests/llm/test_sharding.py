from __future__ import annotations

import random
import zlib
from collections import Counter

from pyspark.sql import functions as F

from palimpsest.llm import sharding


def test_shards_are_near_equal_and_gapless(docs):
    rng = random.Random(3)
    texts = ["x" * int(rng.expovariate(1 / 300)) + str(k) for k in range(900)] + ["copy" * 50] * 500 + [None, "", "y" * 9000]
    rows = sharding.assign(docs(texts)).collect()
    assert len(rows) == len(texts)
    assert all((r.size, r.text_crc32) == (len(texts[r.doc_id] or "") + 1, zlib.crc32((texts[r.doc_id] or "").encode())) for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    assert set(by) == set(range(16))
    assert all(sorted(r.slot for r in own) == list(range(len(own))) for own in by.values())
    sizes = [sum(r.size for r in own) for own in by.values()]
    assert max(sizes) - min(sizes) <= 2 * 9001
    texts = Counter(texts)
    cut = [t for t in texts if texts[t] > 1 and len({r.shard for r in rows if r.text_crc32 == zlib.crc32((t or "").encode())}) > 1]
    assert cut in ([], ["copy" * 50])  # a group is cut only where it is larger than the tolerance


def test_splitters_are_the_ends_of_shards(docs, monkeypatch):
    table = docs(["t" * (k % 90) + str(k) for k in range(1500)])
    even = sharding.assign(table).groupBy("shard").agg(F.sum("size").alias("n")).toPandas().n
    assert len(even) == 16 and (even.max() - even.min()) / even.mean() < 0.05
    monkeypatch.setattr(sharding, "_quantiles", lambda keys, parts: keys[:0])
    assert sharding.assign(table).select("shard").distinct().count() == 1


def test_overfull_ranges_are_split_again(docs, monkeypatch):
    monkeypatch.setattr(sharding, "DRAWN", 1)
    monkeypatch.setattr(sharding, "RANGES", 2)
    rows = sharding.assign(docs(["t" * (k % 90) for k in range(2000)])).collect()
    sizes = [sum(r.size for r in rows if r.shard == s) for s in range(16)]
    assert sum(sizes) == sum(k % 90 + 1 for k in range(2000)) and max(sizes) - min(sizes) <= 180


def test_repeated_rows_null_ids_and_empty_tables(docs):
    rows = sharding.assign(docs(["same"] * 40, ids=[None, 1] * 20)).collect()
    assert len(rows) == 40 and all(len({(r.shard, r.slot) for r in rows}) == 40 for _ in [0])
    assert sharding.assign(docs([])).count() == 0


def test_written_shards_hold_every_row_in_order(spark, docs, tmp_path):
    table = docs([str(k) * 5 for k in range(50)] + [None], ids=[*range(49), 3, None])
    table = table.unionByName(table).withColumn("shard", F.lit(7)).withColumn("slot", F.lit("x")).withColumn("__id", F.lit(0))
    assert sharding.write_shards(table, str(tmp_path / "out")) == "shard_"
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.columns == [*table.columns, "shard_"]
    assert Counter(map(tuple, got.select(table.columns).collect())) == Counter(map(tuple, table.collect()))


def test_a_very_long_text_fills_shards_alone(docs):
    rows = sharding.assign(docs(["z" * 3_000_000, "a", "b"])).collect()
    assert sorted(r.size for r in rows) == [2, 2, 3_000_001] and all(0 <= r.shard < 16 for r in rows)
