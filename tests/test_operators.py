"""Operators against small cases and plain Python."""

from __future__ import annotations

import io
import itertools
import random
import struct
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.functions import codecs, labels
from palimpsest.operators import diff, merge_layers, raster, reports, store, trees
from palimpsest.sources import palettes


def test_fold_takes_the_last_change_and_drops_removed_paths(spark):
    log = spark.createDataFrame([("b", "x", 1, "A"), ("b", "x", 3, "C"), ("b", "y", 2, "M"), ("b", "y", 4, "D")], "branch string, path string, seq int, status string")
    assert [tuple(r) for r in trees.fold(log).select("path", "seq", "status").collect()] == [("x", 3, "C")]


def test_fold_of_an_empty_log_is_empty(spark):
    log = spark.createDataFrame([], "branch string, path string, seq int, status string")
    assert trees.fold(log).count() == 0


def test_ancestors_of_a_diamond_keep_a_dangling_parent(spark):
    edges = spark.createDataFrame([(4, 2), (4, 3), (2, 1), (3, 1), (1, 99)], "id int, parent int")
    found = trees.ancestors(edges, spark.createDataFrame([(4,)], "id int"))
    assert sorted(r.ancestor for r in found.collect()) == [1, 2, 3, 4, 99]


@pytest.mark.parametrize("length", [1, 2, 7, 8, 9])
def test_chains_follow_first_parents(spark, length):
    parents = spark.createDataFrame([(k, k - 1 if k else None) for k in range(length)], "id int, parent int")
    found = trees.chains(parents, spark.createDataFrame([(length - 1,)], "id int"), length)
    assert sorted(r.ancestor for r in found.collect()) == list(range(length))


def test_merge_base_is_the_last_common_commit(spark):
    forks = spark.createDataFrame([("b", "a", 3), ("c", "b", 5)], "segment string, parent_segment string, fork int")
    tips = spark.createDataFrame([(9, "a", 9), (8, "b", 8), (7, "c", 7)], "start int, segment string, upto int")
    lineage = trees.lineages(forks, tips)
    pairs = spark.createDataFrame([(9, 8), (8, 7), (9, 7)], "left int, right int")
    assert {(r.left, r.right): r.base for r in trees.merge_bases(pairs, lineage).collect()} == {(9, 8): 3, (8, 7): 5, (9, 7): 3}


def merged(base, current, source):
    """The merge rule for one path, None for absent."""
    if source == current or source == base:
        return None
    conflict = current != base
    if source is not None:
        return ("C" if conflict else "M" if current is not None else "A", source)
    if current is not None:
        return ("C", current) if conflict else ("D", None)
    return None


def test_three_way_merge_on_every_combination(spark):
    cases = list(itertools.product([None, "1", "2", "3"], repeat=3))
    sides = [spark.createDataFrame([(k, c[s]) for k, c in enumerate(cases) if c[s] is not None], "path int, content string") for s in range(3)]
    got = {r.path: (r.status, r.content) for r in diff.three_way(*sides).collect()}
    assert got == {k: m for k, c in enumerate(cases) if (m := merged(*c))}


def test_applying_tree_changes_gives_the_target(spark):
    old, new = {"a": 1, "b": 2, "c": None}, {"b": 3, "c": None, "d": 4}
    frames = [spark.createDataFrame(list(t.items()), "path string, content int") for t in (old, new)]
    tree = dict(old)
    for r in diff.tree_changes(*frames).collect():
        tree.pop(r.path, None) if r.status == "D" else tree.update({r.path: r.content})
    assert tree == new


def test_keyed_list_diff_pairs_occurrences_in_order(spark):
    rng = random.Random(4)
    old = [(rng.choice("ab"), k, rng.randint(0, 2)) for k in range(12)]
    new = [(rng.choice("ab"), k, rng.randint(0, 2)) for k in range(12)]
    frames = [spark.createDataFrame(t, "name string, pos int, colour int") for t in (old, new)]
    got = sorted(repr((r.name, r.before, r.after, r.change)) for r in diff.keyed_list_diff(*frames, ["name"], "colour", "pos").collect())
    want, left = [], list(old)
    for name, _, after in new:
        hit = next((o for o in left if o[0] == name), None)
        if hit:
            left.remove(hit)
            want.append((name, hit[2], after, "unchanged" if hit[2] == after else "modified"))
        else:
            want.append((name, None, after, "added"))
    want += [(name, before, None, "removed") for name, _, before in left]
    assert got == sorted(map(repr, want))


def test_a_removed_tile_changes_its_entry_but_not_the_box(spark):
    old = spark.createDataFrame([("e", 0, 0, "a"), ("e", 64, 0, "b"), ("gone", 0, 0, "c")], "entry string, x int, y int, hash string")
    new = spark.createDataFrame([("e", 0, 0, "a")], "entry string, x int, y int, hash string")
    assert [(r.entry, r.changed_tiles, r.x0) for r in diff.changed_entries(old, new, 64).collect()] == [("e", 0, None)]


def test_chain_lengths_match_a_loop(spark):
    rng = random.Random(7)
    rows = [("s", k, rng.random() < 0.9) for k in range(120)]
    got = [r.chain_len for r in store.chain_lengths(spark.createDataFrame(rows, "stream string, seq int, ok boolean"), F.col("ok")).orderBy("seq").collect()]
    want, head = [], None
    for _, _, ok in rows:
        head = head + 1 if ok and head is not None and head + 1 <= store.MOST_PATCHES else 0
        want.append(head)
    assert got == want


def test_prune_keeps_the_newest_that_fit(spark):
    files = spark.createDataFrame([("r", k, 10) for k in range(6)], "repo string, mtime int, size int")
    assert sorted(r.mtime for r in store.prune(files, F.lit(25), "repo", ["mtime"]).collect()) == [0, 1, 2, 3]


def test_retention_is_greedy_not_a_prefix(spark):
    files = spark.createDataFrame([("r", 0, 5), ("r", 1, 9), ("r", 2, 4)], "repo string, seq bigint, size bigint")
    assert {r.seq: r.kept for r in store.retained(files, "repo", "seq", "size", 10).collect()} == {0: True, 1: False, 2: True}


def test_a_pack_at_a_quarter_is_kept(spark):
    row = spark.range(1).select(store.worth_rewriting(F.lit(25), F.lit(100)).alias("at"), store.worth_rewriting(F.lit(26), F.lit(100)).alias("over")).first()
    assert (row["at"], row["over"]) == (False, True)


def test_garbage_counters_add_up(spark):
    objects = spark.createDataFrame([("r", k, 10 * k) for k in range(5)], "repo string, object int, size int")
    live = spark.createDataFrame([("r", 1), ("r", 2)], "repo string, object int")
    row = reports.garbage(objects, live, live.where("object = 2"), "repo").first()
    assert (row.objects, row.live_objects, row.dead_objects, row.dead_bytes) == (5, 2, 3, 70)


def test_first_merge_sample_fills_only_an_empty_slot(spark):
    rows = [("merge", 5, 1, "a"), ("merge", 6, 2, "a"), ("commit", 7, 3, "b"), ("rollback", 8, 4, "b"), ("diff", 9, 5, "b")]
    got = {r.commit_id: (r.save_ms, r.compare_ms) for r in reports.timing_by_commit(spark.createDataFrame(rows, "op string, ms int, ts int, commit_id string")).collect()}
    assert got == {"a": (5, None), "b": (7, 9)}


def test_lanes_of_a_merge(spark):
    commits = spark.createDataFrame([(0, 1, 1, []), (0, 2, 2, [1]), (0, 3, 3, [1]), (0, 4, 4, [2, 3])], "repo bigint, seq bigint, id bigint, parents array<bigint>")
    assert {r.id: r.lane for r in reports.lanes(commits).collect()} == {4: 0, 3: 1, 2: 0, 1: 0}


def test_outline_of_a_square(spark):
    grid = spark.createDataFrame([(1, x, y, 1 <= x <= 2 and 1 <= y <= 2) for x in range(4) for y in range(4)], "image long, x int, y int, changed boolean")
    row = raster.outlines(grid).first()
    assert (row.edges, row.loops, row.path) == (8, 1, "M1 1L3 1L3 3L1 3Z")


def test_edges_of_odd_grids(spark):
    rng = random.Random(5)
    cells = {(k, x, y) for k in (1, 2) for x in range(-3, 4) for y in range(-2, 5) if rng.random() < 0.6}
    grid = spark.createDataFrame([(*c, True) for c in cells] + [(1, 9, 9, True), (1, 9, 9, True), (3, 0, 0, False), (4, 0, 0, None)], "image long, x int, y int, changed boolean")
    cells |= {(1, 9, 9)}
    sides = {(0, -1): (0, 0, 1, 0), (1, 0): (1, 0, 1, 1), (0, 1): (1, 1, 0, 1), (-1, 0): (0, 1, 0, 0)}
    want = [(k, x + ax, y + ay, x + bx, y + by) for k, x, y in [*cells, (1, 9, 9)] for (dx, dy), (ax, ay, bx, by) in sides.items() if (k, x + dx, y + dy) not in cells]
    assert sorted(tuple(r) for r in raster.boundary(grid).collect()) == sorted(want)
    assert {r.image: r.edges for r in raster.outlines(grid).collect()} == {k: sum(w[0] == k for w in want) for k in (1, 2)}


def test_outlines_make_their_grid_once(spark):
    apart = [(1, 2 * k, 0, True) for k in range(2000)] + [(2, 2 * k, 0, True) for k in range(2001)]  # 8,000 and 8,004 edges
    apart += [(3, x, y, True) for x in range(60) for y in range(60)]
    grid = spark.createDataFrame(apart, "image long, x int, y int, changed boolean")
    made = raster.outlines(grid)
    assert sorted((r.image, r.edges, r.loops) for r in made.collect()) == [(1, 8000, 2000), (3, 240, 1)]
    plan = made._jdf.queryExecution()
    assert plan.optimizedPlan().collectLeaves().size() == 2 and "ReusedExchange" in plan.executedPlan().toString()


def test_unique_names_count_up(spark):
    layers = spark.createDataFrame([(1, k, n) for k, n in enumerate(["ink", "ink", "sky", "ink [2]", "ink"])], "document long, pos long, name string")
    taken = spark.createDataFrame([(1, "sky"), (1, "sky [2]"), (2, "ink"), (1, "ink [4]")], "document long, name string")
    assert [r.new_name for r in merge_layers.renamed(layers, taken).orderBy("pos").collect()] == ["ink", "ink [2]", "sky [3]", "ink [2] [2]", "ink [3]"]
    assert [r.new_name for r in merge_layers.renamed(layers, taken.limit(0)).orderBy("pos").collect()] == ["ink", "ink [2]", "sky", "ink [2] [2]", "ink [3]"]


def test_files_are_numbered_above_the_taken_ones(spark):
    layers = spark.createDataFrame([(d, k) for d in (1, 2) for k in (5, 7)], "document long, pos long")
    taken = spark.createDataFrame([(1, "layer9"), (1, "layer12"), (1, "layer30a"), (1, "mask99"), (2, "shape1")], "document long, file string")
    got = sorted((r.document, r.pos, r.new_file) for r in merge_layers.renumbered(layers, taken).collect())
    assert got == [(1, 5, "layer13"), (1, 7, "layer14"), (2, 5, "layer1"), (2, 7, "layer2")]


def column(spark, function, *cases):
    """What a column expression makes of literal arguments; each case is (arguments..., wanted)."""
    got = [spark.range(1).select(function(*map(F.lit, c[:-1])).alias("v")).first().v for c in cases]
    assert got == [c[-1] for c in cases]


def test_labels(spark):
    column(spark, labels.blend_mode, ("multiply", "multiply"), ("svg:multiply", "multiply"), ("svg:screen", "screen"), ("overlay", "overlay"), ("linear_dodge", "add"), ("darken", "normal"), ("lighten", "normal"), ("erase", "normal"), ("", "normal"))
    column(spark, labels.status_verb, ("M", "Updated"), ("A", "Added"), ("D", "Deleted"), ("R", "Renamed"), ("C", "Needs review"), ("U", "New"))
    column(spark, labels.title_case, ("skin-tones", "Skin Tones"), ("hero", "Hero"), ("  a__b--c  d ", "A B C D"), ("", ""))
    column(spark, labels.palette_key, ("p/Sun-Set.0006.kpl", "sun-set"), ("sun-set.gpl", "sun-set"), ("a.png", "a.png"), ("a.12", "a"), ("x.v2.aco", "x.v2"))
    column(spark, labels.shard_of, ("file:a:tile:b", "a:tile:b"), ("kra:a:tile:e:entry:f:0,0", "a"), ("kra:a:entry:x:tile:y", "a:entry:x"), ("kra:a:entry:x", "a"), ("kra:a:manifest", "a"), ("kra:a", "a"), ("other", "other"))
    column(spark, labels.asset_name, ("a/b\\\\skin-tones_2.kra".replace("\\\\", "\\"), "skin tones 2"), ("-.kra", "-.kra"), ("x.tar.gz", "x.tar"))
    column(spark, labels.palette_name, ("f.kra::sun-set.0006.kpl", "sun set"), ("p/x_y.gpl", "x y"))
    column(spark, labels.asset_kind, ("a.KRA", "Artwork"), ("a.gpl", "Palette"), ("a.webp", "Reference"), ("a.kpl", "Settings"))
    column(spark, labels.layer_type, ("adjustmentlayer", "Filter"), ("shapelayer", "Vector"), ("selectionmask", "Mask"), ("colorizelayer", "Colorize"), ("", "Layer"))
    column(spark, labels.byte_text, (0, "0 B"), (1023, "1023 B"), (1024, "1.0 KB"), (1434, "1.4 KB"), (12 << 20, "12.0 MB"), (3 << 40, "3.0 TB"), (5 << 50, "5120.0 TB"))
    column(spark, labels.ms_text, (840.4, "840ms"), (1300.0, "1.3s"), (999.9, "1000ms"))
    column(spark, labels.operation_label, ("commit", "Commit"))
    column(spark, lambda o: labels.operation_label(o, True), ("diff", "Compare"), ("create", "New line"), ("x", "x"))
    column(spark, labels.object_name, ("h", None, "h.full"), ("h", "b", "h.b.patch"))
    column(spark, labels.default_pixel, (b"\x01\x02\x03\x04", b"\x03\x02\x01\x04"), (b"\x01", None))
    column(spark, labels.compressed, (b"\x89PNG\r", True), (b"PK\x03\x04", True), (b"\x28\xb5\x2f\xfd", True), (b"PK", False))
    column(spark, labels.with_name, ('<layer filename="a" name="b" x="1">', "c&amp;d", '<layer filename="a" name="c&amp;d" x="1">'), ('<layer filename="a">', "c", None))


def test_times_ago(spark):
    now = "2026-06-26 14:32:00"
    cases = [("2026-06-26 14:31:31", "just now"), ("2026-06-26 14:31:30", "1m ago"), ("2026-06-26 13:33:00", "59m ago"), ("2026-06-26 13:02:00", "2h ago"), ("2026-06-25 14:32:00", "1d ago"), ("2026-06-19 14:32:00", "Jun 19")]
    at = lambda x: F.to_timestamp(F.lit(x))
    assert [spark.range(1).select(labels.relative_time(at(c), at(now)).alias("v")).first().v for c, _ in cases] == [w for _, w in cases]
    assert spark.range(1).select(labels.full_timestamp(at(now)).alias("v")).first().v == "Jun 26, 2026 · 14:32"


def test_layer_changes_follow_the_new_order_and_carry_old_and_new_values(spark):
    schema = "pos int, uuid string, name string, opacity long, blend string"
    old = spark.createDataFrame([(0, "u", "ink", 255, "normal"), (1, "u", "later", 9, "x"), (2, "", "gone", 255, "normal"), (3, "", "gone", 1, "normal")], schema)
    new = spark.createDataFrame([(0, "", "fresh", 255, "normal"), (1, "u", "ink two", 100, "multiply"), (2, "u", "ink", 255, "normal")], schema)
    got = [(r.name, r.change, r.details) for r in diff.layer_changes(old, new).orderBy("place").collect()]
    assert got == [("fresh", "added", []), ("ink two", "modified", ["opacity 255 -> 100", "blend normal -> multiply", "renamed ink -> ink two"]), ("gone", "removed", []), ("gone", "removed", [])]


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=600) | st.lists(st.sampled_from([b"ab", b"a" * 300, b"xyz"]), max_size=8).map(b"".join))
def test_lzf_round_trip(data):
    assert codecs.unpack(codecs.pack(data), len(data)) == data


def test_lzf_rejects_broken_streams():
    assert codecs.unpack(b"\x05ab", 6) is None
    assert codecs.unpack(b"\xff", 6) is None


def test_planar_round_trip(spark):
    df = spark.createDataFrame([(bytes(range(16)),), (None,)], "p binary").withColumn("q", codecs.planar_to_rgba("p")).withColumn("r", codecs.rgba_to_planar("q"))
    assert all(row.p == row.r for row in df.collect())


def test_text_palette(spark):
    text = "GIMP Palette\nColumns: 3\n# x\n255 0 0 Red\r\n0 255 0\tGreen  two\n300 -5 7\n"
    got = [(r.pos, r.name, r.r, r.g, r.b) for r in palettes.gpl(spark.createDataFrame([("p", text)], "file string, text string")).orderBy("pos").collect()]
    assert got == [(0, "Red", 255, 0, 0), (1, "Green two", 0, 255, 0), (2, "#FF0007", 255, 0, 7)]


def test_binary_palettes():
    aco = struct.pack(">HHHHHHH", 1, 1, 0, 0xFFFF, 0, 0, 0)
    name = "Hi\0".encode("utf-16-be")
    body = struct.pack(">H", 3) + name + b"RGB " + struct.pack(">fff", 0, 0.5, 1) + struct.pack(">H", 0)
    ase = b"ASEF" + struct.pack(">HHI", 1, 0, 1) + struct.pack(">HI", 1, len(body)) + body
    assert palettes.parse("a.aco", aco) == [("#FF0000", 255, 0, 0)]
    assert palettes.parse("a.ASE", ase) == [("Hi", 0, 128, 255)]
    assert palettes.parse("a.ase", ase[:20]) == []
    assert palettes.lab_to_rgb(100, 0, 0) == (255, 255, 255)
    one = lambda space, *c: palettes.parse("a.aco", struct.pack(">HHHHHHH", 1, 1, space, *c))[0][1:]
    assert one(0, 32768, 128, 65535, 0) == (128, 0, 255) and one(8, 10000, 0, 0, 0) == (255, 255, 255) and one(8, 2500, 0, 0, 0) == (64, 64, 64)
    assert one(2, 65535, 65535, 65535, 65535) == (255, 255, 255) and one(7, 1, 2, 3, 4) == (128, 128, 128)
    v2 = struct.pack(">HHHHHHHI", 2, 1, 0, 0, 0, 0, 0, 3) + "Hi\0".encode("utf-16-be")
    assert palettes.parse("a.aco", aco + v2) == [("Hi", 255, 0, 0)] and palettes.parse("a.aco", aco + v2[:-2]) == [("#FF0000", 255, 0, 0)]


def kpl(inner):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr("colorset.xml", f"<Colorset columns='2'>{inner}</Colorset>")
    return out.getvalue()


def test_zipped_palettes():
    inner = "<Group><ColorSetEntry name=' Sky '><sRGB r='0' g='0.5' b='1'/></ColorSetEntry></Group><ColorSetEntry name=''><Gray g='1'/></ColorSetEntry><ColorSetEntry name='k'><Lab/><CMYK c='0' m='0' y='0' k='1'/></ColorSetEntry><ColorSetEntry name='bad'><RGB r='x' g='0' b='0'/></ColorSetEntry>"
    assert palettes.parse("a.kpl", kpl(inner)) == [("Sky", 0, 128, 255), ("#FFFFFF", 255, 255, 255), ("k", 0, 0, 0)]


def test_columns_of_text_palettes(spark):
    files = spark.createDataFrame([("a", "Columns: 3\n1 2 3"), ("b", "1 2 3"), ("c", " Columns: x\n"), ("d", "Columns: 3\nColumns:7")], "file string, text string")
    assert {r.file: r.columns for r in palettes.gpl_columns(files).collect()} == {"a": 3, "b": 0, "c": 0, "d": 7}
    big = spark.createDataFrame([("p", "99999999999 1 2 too big\n+1 2 3 ok")], "file string, text string")
    assert [(r.name, r.r) for r in palettes.gpl(big).collect()] == [("ok", 1)]
    row = spark.range(1).select(palettes.columns_of_both(F.lit(4), F.lit(0)).alias("a"), palettes.columns_of_both(F.lit(4), F.lit(2)).alias("b"), palettes.columns_of_both(F.lit(None), F.lit(None)).alias("c")).first()
    assert (row.a, row.b, row.c) == (4, 2, 0)


def test_saved_percent_is_clamped(spark):
    cases = [(1, 10_000, 99), (9_999, 10_000, 1), (0, 10, 100), (10, 10, 0), (5, 0, 0)]
    df = spark.createDataFrame([c[:2] for c in cases], "a long, n long").select(labels.saved_percent(F.col("a"), F.col("n")).alias("p"))
    assert [r.p for r in df.collect()] == [c[2] for c in cases]


def test_safe_paths(spark):
    paths = {"a/b.kra": True, "": False, "/a": False, "../a": False, "a/../b": False, "./a": False, "a..b": True}
    df = spark.createDataFrame([(p,) for p in paths], "p string").select("p", labels.safe_path(F.col("p")).alias("ok"))
    assert {r.p: r.ok for r in df.collect()} == paths
