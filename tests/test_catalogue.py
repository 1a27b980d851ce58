"""Every SQL-expressible query against DuckDB on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from palimpsest.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(names, found):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(repr([r[k] for k in order]) for r in found)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    result = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    want = rows(names, result.fetchall())
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_has_rows(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


def test_retention_matches_a_loop(spark):
    found = catalogue.queries()["retention_budget"](spark, SF).collect()
    by = {}
    for r in found:
        by.setdefault(r.pack, []).append(r)
    for own in by.values():
        used = 0
        for r in sorted(own, key=lambda r: r.seq):
            assert r.kept == (used + r.size <= 40_000)
            used += r.size * r.kept


def test_layer_names_match_a_loop(spark):
    customers = spark.read.parquet(f"{SF}/customer.parquet").collect()
    suppliers = spark.read.parquet(f"{SF}/supplier.parquet").collect()
    want = set()
    for nation in {s.s_nationkey for s in suppliers}:
        taken = {f"layer {c.c_custkey % 2}" + (" [3]" if c.c_custkey % 10 == 0 else "") for c in customers if c.c_nationkey == nation and c.c_custkey % 5 == 0}
        for s in sorted((s for s in suppliers if s.s_nationkey == nation), key=lambda s: s.s_suppkey):
            name = new = f"layer {s.s_suppkey % 3}"
            k = 2
            while new in taken:
                new, k = f"{name} [{k}]", k + 1
            taken.add(new)
            want.add((nation, s.s_suppkey, name, new))
    assert {tuple(r) for r in catalogue.queries()["layer_names"](spark, SF).collect()} == want


def test_lanes_match_a_loop(spark):
    """Newest first: a commit takes the lowest lane that waits for it, or the first free one; its first parent goes on there."""
    found = catalogue.queries()["commit_lanes"](spark, SF).collect()
    parents = {r.id: r.parent for r in __import__("palimpsest.plans.views", fromlist=["parents"]).parents(spark, SF).collect()}
    by = {}
    for r in found:
        by.setdefault(r.repo, {})[r.id] = r.lane
    for lanes in by.values():
        waiting = []
        for ident in sorted(lanes, reverse=True):
            mine = [k for k, w in enumerate(waiting) if w == ident]
            lane = mine[0] if mine else next((k for k, w in enumerate(waiting) if w is None), len(waiting))
            assert lanes[ident] == lane
            if lane == len(waiting):
                waiting.append(None)
            for k in mine:
                waiting[k] = None
            waiting[lane] = parents[ident] if parents[ident] in lanes else None


def test_tiles_come_back(spark):
    assert all(r.same and r.packed_bytes for r in catalogue.queries()["tile_codecs"](spark, SF).collect())
