"""Documents: manifests, rasters, composites, overlays, and the repository's comparisons of them."""

from __future__ import annotations

import io
import os
import random
import re
import zipfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.functions import png
from palimpsest.operators import documents as d
from palimpsest.operators import document_merge, raster, versions
from palimpsest.plans import archive
from palimpsest.repository import Locked, Repository
from palimpsest.sources import archives, worktree


def solid(*rgba):
    """A stored 64 by 64 tile of one colour."""
    r, g, b, a = rgba
    return d.stored_tile(bytes([b]) * 4096 + bytes([g]) * 4096 + bytes([r]) * 4096 + bytes([a]) * 4096)


def document(layers, palette=None, size=(128, 64), composite=None):
    """A document archive; layers are (name, uuid, filename, tiles [(x, y, stored)], attributes)."""
    xml = "".join(f'<layer name="{n}" uuid="{u}" filename="{f}" nodetype="paintlayer" {extra}/>' for n, u, f, _, extra in layers)
    parts = {
        "mimetype": b"application/x-document",
        "maindoc.xml": f'<DOC><IMAGE name="I" width="{size[0]}" height="{size[1]}"><layers>{xml}</layers></IMAGE></DOC>'.encode(),
        "I/layers/layer1.defaultpixel": bytes([9, 8, 7, 255]),
    }
    for _, _, f, tiles, _ in layers:
        parts[f"I/layers/{f}"] = archives.tiled_block([(x, y, "LZF", t) for x, y, t in tiles])
    if palette:
        parts["I/palettes/sun.0001.gpl"] = palette
    if composite is not None:
        parts["mergedimage.png"] = png.encode(composite.shape[1], composite.shape[0], composite.tobytes())
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name, content in parts.items():
            archive.writestr(name, content)
    return out.getvalue()


OLD = document([("ink", "{1}", "layer1", [(0, 0, solid(1, 2, 3, 255)), (64, 0, solid(9, 9, 9, 255))], ""), ("sky", "{2}", "layer2", [(0, 0, solid(5, 5, 5, 255))], ""), ("gone", "{3}", "layer3", [], "")], b"GIMP Palette\n255 0 0 Red\n1 2 3 Same\n")
NEW = document([("ink", "{1}", "layer1", [(0, 0, solid(200, 2, 3, 255)), (64, 0, solid(9, 9, 9, 255))], ""), ("sky", "{2}", "layer2", [(0, 0, solid(5, 5, 5, 255))], 'opacity="128"'), ("new", "{4}", "layer4", [(-32, 0, solid(7, 7, 7, 255))], "")], b"GIMP Palette\n0 0 255 Red\n1 2 3 Same\n")


def side(spark, content, file="f.kra"):
    return Repository._side(spark.createDataFrame([(file, content)], "file string, content binary"))


def test_entries_with_the_same_checksum_and_size_are_reused(spark):
    old, new = side(spark, OLD), side(spark, NEW)
    first = d.manifest(old["entries"])
    second = {r.entry_path: r for r in d.manifest(new["entries"], first).collect()}
    assert second["mimetype"].reused and not second["maindoc.xml"].reused and not second["I/layers/layer1"].reused and second["I/layers/layer2"].reused
    assert second["I/layers/layer2"].blob == {r.entry_path: r.blob for r in first.collect()}["I/layers/layer2"]
    empty = first.where("size > 0").limit(1).withColumn("size", F.lit(0).cast("long"))
    assert [r.x for r in empty.select(d.reusable(F.col("crc32"), F.col("size"), F.col("crc32"), F.col("size")).alias("x")).collect()] == [False]


def test_streams_and_the_plan_to_rebuild(spark):
    old, new = side(spark, OLD), side(spark, NEW)
    before, after = d.manifest(old["entries"]), d.manifest(new["entries"])
    streams = {r.stream for r in d.referenced_streams(before, d.tile_refs(old["tiles"])).collect()}
    assert {"kra:f.kra:tile:I/layers/layer1:0,0", "kra:f.kra:tile:I/layers/layer1:64,0", "kra:f.kra:entry:maindoc.xml"} <= streams and "kra:f.kra:entry:I/layers/layer1" not in streams
    plan = {r.entry_path: (r.action, r.tiles, r.reused_tiles) for r in d.rebuild_plan(after, before, d.tile_refs(new["tiles"]), d.tile_refs(old["tiles"])).collect()}
    assert plan["I/layers/layer1"] == ("write", 2, 1) and plan["I/layers/layer2"] == ("copy", 1, 1) and plan["I/layers/layer4"] == ("write", 1, 0) and plan["mimetype"][0] == "copy"
    assert {r.stem for r in d.layer_stems(old["entries"], old["images"]).collect()} == {"layer1", "layer2", "layer3"}


def test_patch_bases_offsets_and_leftovers(spark):
    versions = spark.createDataFrame([("s", "a", None), ("s", "b", "a"), ("s", "c", "b"), ("t", "c", "z")], "stream string, content string, base string")
    live = spark.createDataFrame([("s", "c")], "stream string, content string")
    assert {(r.stream, r.content) for r in d.closed_over_bases(live, versions, 20).collect()} == {("s", "a"), ("s", "b"), ("s", "c")}
    objects = spark.createDataFrame([("p", k, n) for k, n in enumerate((5, 7, 1))], "pack string, pos int, size int")
    assert [r.offset for r in d.pack_offsets(objects, "pack", ["pos"], 10).orderBy("pos").collect()] == [10, 15, 22]
    hour = 3600 * 10**9
    files = spark.createDataFrame([("s/a.tmp", 1, 0), ("s/b.tmp", 1, hour), ("s/deep/c.tmp", 1, 0), ("s/d.json", 1, 0)], "path string, size long, mtime_ns long")
    assert [r.path for r in d.stale_temporary(files, ["s"], 2 * hour).collect()] == ["s/a.tmp"]


def test_blit_cuts_at_every_edge():
    tile = np.arange(64, dtype=np.uint8).reshape(4, 4, 4)
    for x in range(-5, 8):
        for y in range(-5, 8):
            canvas, want = np.zeros((6, 7, 4), np.uint8), np.zeros((6, 7, 4), np.uint8)
            d.blit(canvas, x, y, tile)
            for r in range(4):
                for c in range(4):
                    if 0 <= y + r < 6 and 0 <= x + c < 7:
                        want[y + r, x + c] = tile[r, c]
            assert (canvas == want).all()


def test_capped_pictures_are_area_averages():
    rng = np.random.default_rng(0)
    rgba = rng.integers(0, 256, (37, 53, 4), np.uint8)
    rgba[:9, :9, 3] = 0
    got = d.capped(rgba, 20)
    height, width = got.shape[:2]
    assert (width, height) == (20, int(37 * 20 / 53 + 0.5)) and d.capped(rgba, 53) is rgba
    for y in range(height):
        for x in range(width):
            box = rgba[y * 37 // height : max((y + 1) * 37 // height, y * 37 // height + 1), x * 53 // width : max((x + 1) * 53 // width, x * 53 // width + 1)].reshape(-1, 4).astype(int)
            alpha = box[:, 3].sum()
            want = [(2 * (box[:, c] * box[:, 3]).sum() + alpha) // (2 * alpha) if alpha else 0 for c in range(3)]
            assert got[y, x].tolist() == [*want, (2 * alpha + len(box)) // (2 * len(box))]


def test_layer_rasters_lie_on_the_default_pixel(spark):
    new = side(spark, NEW)
    got = {r.entry_path: r for r in d.layer_rasters(new["tiles"], new["images"], d.default_pixels(new["entries"])).collect()}
    pixels = {k: np.frombuffer(png.decode(r.png)[2], np.uint8).reshape(64, 128, 4) for k, r in got.items()}
    assert pixels["I/layers/layer1"][0, 0].tolist() == [200, 2, 3, 255] and pixels["I/layers/layer1"][63, 127].tolist() == [9, 9, 9, 255]
    assert pixels["I/layers/layer4"][0, 31].tolist() == [7, 7, 7, 255] and pixels["I/layers/layer4"][0, 32].tolist() == [0, 0, 0, 0]
    refs = d.tile_refs(new["tiles"]).groupBy("entry_path").agg(F.collect_list(F.struct("x", "y", "hash")).alias("tiles"))
    fill = F.when(F.col("entry_path") == "I/layers/layer1", F.lit(bytes([7, 8, 9, 255])))
    keys = {r.entry_path: r.key for r in refs.select("entry_path", d.layer_key(F.col("entry_path"), F.lit(128), F.lit(64), fill, F.col("tiles")).alias("key")).collect()}
    assert keys == {k: r.key for k, r in got.items()}


def test_composites_come_back_pixel_by_pixel(spark):
    picture = np.random.default_rng(1).integers(0, 256, (300, 520, 4), np.uint8)
    entries = side(spark, document([], composite=picture))["entries"]
    blocks = d.composite_blocks(entries)
    assert sorted((r.x, r.y, len(r.pixels)) for r in blocks.collect()) == sorted((x, y, min(256, 520 - x) * min(256, 300 - y) * 4) for x in (0, 256, 512) for y in (0, 256))
    assert png.decode(d.composite_png(blocks).first().png)[2] == picture.tobytes()
    assert d.composite_blocks(entries.withColumn("content", F.lit(b"no picture"))).count() == 0


def test_overlays(spark):
    before, after = np.zeros((40, 20, 4), np.uint8), np.zeros((80, 40, 4), np.uint8)
    after[20:40, 10:30] = 200
    after[0, 0] = 16  # within the tolerance
    as_png = lambda p: png.encode(p.shape[1], p.shape[0], p.tobytes())
    rows = [(1, as_png(before), as_png(after)), (2, as_png(before), as_png(before)), (3, None, as_png(after)), (4, b"x", as_png(after))]
    got = {r.id: r for r in d.overlays(spark.createDataFrame(rows, "id int, before binary, after binary")).collect()}
    assert (got[1].x, got[1].y, got[1].w, got[1].h) == (0.25, 0.25, 0.5, 0.25) and got[1].outline == "M0.2500 0.2500L0.7500 0.2500L0.7500 0.5000L0.2500 0.5000Z"
    mask = np.frombuffer(png.decode(got[1].mask)[2], np.uint8).reshape(80, 40, 4)
    assert mask[25, 15].tolist() == list(d.HIGHLIGHT) and mask[0, 0].tolist() == [0, 0, 0, 0]
    assert got[2].mask is not None and got[2].outline is None and got[3].mask is None and got[4].mask is None


def test_outlines_of_random_grids_cover_the_changed_cells(spark):
    rng = random.Random(3)
    grid = np.array([[rng.random() < 0.4 for _ in range(9)] for _ in range(7)])
    table = spark.createDataFrame([(1, x, y, bool(grid[y, x])) for x in range(9) for y in range(7)], "image long, x int, y int, changed boolean")
    row = raster.outlines(table).first()
    lines = [[tuple(float(v) for v in p.split()) for p in part.rstrip("Z").split("L")] for part in row.path.split("M")[1:]]
    scaled = [[(round(x * 9), round(y * 7)) for x, y in (tuple(float(v) for v in p.split()) for p in part.rstrip("Z").split("L"))] for part in raster.outline_of(grid).split("M")[1:]]
    for loops in (lines, scaled):
        for y in range(7):
            for x in range(9):
                crossed = sum((ay > y + 0.5) != (by > y + 0.5) and ax > x + 0.5 for loop in loops for (ax, ay), (bx, by) in zip(loop, loop[1:] + loop[:1], strict=True))
                assert crossed % 2 == grid[y, x]


def test_sampled_grids(spark):
    old = spark.createDataFrame([(1, x, y, 100 * (x + 2 * y)) for x in range(2) for y in range(2)], "image int, x int, y int, v int")
    new = spark.createDataFrame([(1, x, y, 100 * (x * 2 // 5 + 2 * (y * 2 // 3)) + (50 if x == 4 else 0)) for x in range(5) for y in range(3)], "image int, x int, y int, v int")
    sizes = spark.createDataFrame([(1, 2, 2, 5, 3)], "image int, before_width int, before_height int, width int, height int")
    assert {(r.x, r.y) for r in raster.sampled_change_grid(old, new, sizes, ["v"]).collect() if r.changed} == {(4, 0), (4, 1), (4, 2)}


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=3000), st.binary(max_size=300), st.integers(0, 3000))
def test_patches_come_back(base, insert, at):
    new = base[:at] + insert + base[at:]
    assert not base or versions.patched(base, versions.patch(base, new)) == new


def test_streams_of_snapshots_and_patches(spark):
    rng = random.Random(2)
    body = rng.randbytes(100_000)
    rows = [("s", k, body[:k * 900] + b"edit" + body[k * 900:]) for k in range(30)] + [("s", 40, body[:0] + b"edit" + body), ("t", 1, b"small"), ("t", 2, b"PK\x03\x04" + body), ("t", 3, body)]
    kept = d_checkpointed(versions.stored(spark.createDataFrame(rows, "stream string, seq long, payload binary")))
    own = kept.where("stream = 's'").orderBy("seq").collect()
    assert [r.chain_len for r in own] == [*range(21), *range(9)] and own[21].object.endswith(".full") and own[20].object == f"{own[20].content}.{own[19].content}.patch"
    assert max(r.size for r in own if r.chain_len) < 2000
    back = {(r.stream, r.seq): bytes(r.payload) for r in versions.replayed(kept).collect()}
    assert back == {(s, k): p for s, k, p in rows if (s, k) != ("s", 40)}
    wanted = kept.where("stream = 's' and seq = 7").select("stream", "content")
    assert [(r.seq, bytes(r.payload)) for r in versions.reconstructed(kept, wanted).collect()] == [(7, rows[7][2])]
    with pytest.raises(Exception, match="does not come back"):
        versions.replayed(kept.withColumn("content", F.lit("x"))).count()


def test_a_long_stream_is_placed_without_its_payloads_and_made_once(spark):
    def nodes(plan):
        yield plan
        for k in range(plan.children().size()):
            yield from nodes(plan.children().apply(k))

    found = list(nodes(archive.patched_streams(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()))
    windows = [n.output().mkString(",") for n in found if n.nodeName() == "Window"]
    assert windows and not any("payload" in w or "text" in w for w in windows)
    assert sum("InArrow" in n.nodeName() or "InPandas" in n.nodeName() for n in found) == 2


def test_versions_without_a_stream_or_handed_in_twice(spark, tmp_path):
    rows = [("s", 1, "a" * 700), ("s", 1, "a" * 700), ("s", 2, "b" * 700), (None, 3, "a" * 700), (None, 4, "c" * 700), (None, 5, "a" * 700), ("s", 6, None)]
    spark.createDataFrame(rows, "source string, doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in archive.patched_streams(spark, str(tmp_path)).collect()]
    assert sorted(got, key=lambda r: r[1]) == [("s", 1, 1, 0, True), ("s", 2, 1, 1, True), (None, 3, 3, 0, True), (None, 4, 3, 1, True), ("s", 6, 6, 0, True)]


def test_chains_by_shard_and_packs(spark, tmp_path):
    rows = [(f"kra:f{k}:tile:e:0,0", v, f"{k} {v}".encode()) for k in range(8) for v in range(2)]
    kept = d_checkpointed(versions.stored(spark.createDataFrame(rows, "stream string, seq long, payload binary")))
    path = str(tmp_path / "chains")
    versions.write_chains(kept, path)
    versions.write_chains(kept.where("stream = 'kra:f3:tile:e:0,0' and seq = 0"), path)
    assert versions.read_chains(spark, path).count() == 15
    assert [r.seq for r in versions.read_chains(spark, path, ["kra:f3:tile:e:0,0"]).collect()] == [0]
    both = versions.all_chains(versions.read_chains(spark, path), kept.where("stream = 'kra:f3:tile:e:0,0'"))
    assert both.count() == 16
    packs = str(tmp_path / "packs")
    versions.write_packs(kept.select("object", "size", "data"), packs, 100)
    (tmp_path / "packs" / "bad.parquet").write_bytes(b"no pack")
    assert versions.pack_index(spark, packs).select("object").distinct().count() == 16 and versions.pack_index(spark, packs).select("pack").distinct().count() > 1


def d_checkpointed(df):
    from palimpsest.operators.trees import checkpointed

    return checkpointed(df)


def read(content):
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        return {n: archive.read(n) for n in archive.namelist()}


def test_changed_layers_are_folded_in(spark):
    base = document([("ink", "{1}", "layer1", [(0, 0, solid(1, 1, 1, 255))], ""), ("mine", "{9}", "layer7", [], "")])
    merged = document_merge.merged(base, NEW, OLD)
    entries = read(merged)
    rows = [(n, a, b, c) for n, a, b, c in (re.search(r'name="([^"]*)" uuid="([^"]*)" filename="([^"]*)"(.*)', line).groups() for line in re.findall(r"<layer [^>]*>", entries["maindoc.xml"].decode()))]
    assert [(n, f) for n, _, f, _ in rows] == [("ink [2]", "layer8"), ("sky", "layer9"), ("new", "layer10"), ("ink", "layer1"), ("mine", "layer7")]
    assert len({u for _, u, _, _ in rows}) == 5 and all(re.fullmatch(r"\{[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\}", u) for _, u, _, _ in rows[:3])
    assert entries["I/layers/layer8"] == read(NEW)["I/layers/layer1"] and entries["I/layers/layer8.defaultpixel"] == bytes([9, 8, 7, 255]) and entries["I/layers/layer7"] == read(base)["I/layers/layer7"]
    assert next(iter(entries)) == "mimetype"
    shuffled = document([("ink", "{1}", "layer5", [(64, 0, solid(9, 9, 9, 255)), (0, 0, solid(1, 2, 3, 255))], 'selected="true"')])
    table = spark.createDataFrame([("a", base, shuffled, document([("ink", "{1}", "layer1", [(0, 0, solid(1, 2, 3, 255)), (64, 0, solid(9, 9, 9, 255))], "")])), ("b", base, NEW, None), ("c", b"x", NEW, None)], "file string, base binary, incoming binary, ancestor binary")
    got = {r.file: (r.content is not None, r.problem) for r in document_merge.merged_documents(table).collect()}
    assert got["b"] == (True, None) and got["c"][1].startswith("no readable") and got["a"][0]  # a default pixel that is new counts as a change


def test_popping_a_stash_folds_layers(spark, tmp_path):
    own = Repository.init(spark, str(tmp_path))
    (tmp_path / "f.kra").write_bytes(OLD)
    own.commit("one", "me")
    (tmp_path / "f.kra").write_bytes(NEW)
    ident = own.stash("me")
    edited = document([("ink", "{1}", "layer1", [(0, 0, solid(50, 50, 50, 255))], "")])
    (tmp_path / "f.kra").write_bytes(edited)
    own.pop_stash(ident)
    names = re.findall(r'<layer name="([^"]*)"', read((tmp_path / "f.kra").read_bytes())["maindoc.xml"].decode())
    assert names == ["ink [2]", "sky", "new", "ink"] and own.stashes().count() == 0


def test_unchanged_files_are_not_read_again(spark, tmp_path, monkeypatch):
    own = Repository.init(spark, str(tmp_path))
    (tmp_path / "a.gpl").write_bytes(b"one")
    (tmp_path / "b.gpl").write_bytes(b"two")
    for name in ("a.gpl", "b.gpl"):
        os.utime(tmp_path / name, ns=(10**18, 10**18))
    assert {r.path for r in own.status().collect()} == {"a.gpl", "b.gpl"}
    asked = []
    real = worktree.hashed
    monkeypatch.setattr(worktree, "hashed", lambda files, root: (asked.extend(r.path for r in files.collect()), real(files, root))[1])
    (tmp_path / "b.gpl").write_bytes(b"new")
    assert {r.path for r in own.status().collect()} == {"a.gpl", "b.gpl"} and asked == ["b.gpl"]


@pytest.fixture(scope="module")
def repo(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("art")
    found = Repository.init(spark, str(root))
    put = lambda name, data: (root / name).write_bytes(data)
    put("f.kra", OLD)
    put("p.gpl", b"GIMP Palette\nColumns: 2\n255 0 0 Red\n")
    put("notes.gpl", b"only text")
    found.first = found.commit("one", "me")
    put("f.kra", NEW)
    put("p.gpl", b"GIMP Palette\n255 0 0 Red\n0 0 9 Blue\n")
    put("notes.gpl", b"other text")
    found.second = found.commit("two", "me")
    put("f.kra", OLD)
    put("fresh.kra", NEW)
    found.put = put
    return found


def test_commit_diff_by_kind(repo):
    assert {r.path: (r.status, r.kind) for r in repo.commit_diff(repo.second).collect()} == {"f.kra": ("M", "art"), "p.gpl": ("M", "palette"), "notes.gpl": ("M", "text")}
    got = {(r.path, r.name): (r.status, r.before, r.after, r.change) for r in repo.commit_palettes(repo.second).collect()}
    assert got == {("p.gpl", "Red"): ("M", "#FF0000", "#FF0000", "unchanged"), ("p.gpl", "Blue"): ("M", None, "#000009", "added"), ("f.kra::sun.0001.gpl", "Red"): ("M", "#FF0000", "#0000FF", "modified"), ("f.kra::sun.0001.gpl", "Same"): ("M", "#010203", "#010203", "unchanged")}


CHANGES = {"ink": "modified", "sky": "modified", "new": "added", "gone": "removed"}


def test_layers_of_a_commit(repo):
    art = {r.name: r for r in repo.commit_art(repo.second).collect()}
    assert {n: r.change for n, r in art.items()} == CHANGES
    assert (art["sky"].opacity, art["ink"].x, art["ink"].w, art["new"].x, art["new"].w, art["gone"].w) == (50, 0, 128, 0, 32, None)
    shown = {r.name: r for r in repo.commit_layers(repo.second, "f.kra").collect()}
    assert {n: r.change for n, r in shown.items()} == CHANGES
    assert (shown["ink"].bx, shown["ink"].by, shown["ink"].bw, shown["ink"].bh) == (0, 0, 0.5, 1) and shown["ink"].outline
    assert shown["sky"].mask is not None and shown["sky"].outline is None and shown["new"].before is None and shown["gone"].after is None
    assert repo.commit_layers(repo.second, "p.gpl").count() == 0


def test_layer_diff_between_commits(repo):
    got = [(r.name, r.change, r.details) for r in repo.layer_diff("f.kra", repo.first, repo.second).orderBy("place").collect()]
    assert got == [("sky", "modified", ["opacity 255 -> 128"]), ("new", "added", []), ("gone", "removed", [])]


def test_working_documents(repo):
    assert [(r.path, r.status, r.kind) for r in repo.working_diff("f.kra").collect()] == [("f.kra", "M", "art")]
    assert [(r.status, r.kind) for r in repo.working_diff("fresh.kra").collect()] == [("A", "art")]
    assert {r.name: r.change for r in repo.working_layers("f.kra").collect()} == {"ink": "modified", "sky": "modified", "gone": "added", "new": "removed"}
    assert {r.change for r in repo.working_art("fresh.kra").collect()} == {"added"}
    assert {(r.name, r.before, r.after) for r in repo.working_palettes("f.kra").collect() if r.change == "modified"} == {("Red", "#0000FF", "#FF0000")}


def test_who_holds_the_lock(repo):
    with repo._locked("testing"), pytest.raises(Locked, match=r"art.* — testing for \d+s"):
        repo.commit("x", "me")


def test_many_repositories_go_on_after_a_failure(spark, repo, tmp_path):
    failed = Repository.export_many(spark, [repo.root, str(tmp_path / "none")], str(tmp_path))
    assert failed == [str(tmp_path / "none")] and any(f.endswith(".zip") for f in os.listdir(tmp_path))
