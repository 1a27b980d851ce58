"""Archives, logs and the stream of commits."""

from __future__ import annotations

import json

import pytest

from palimpsest.sources import archives, logs
from palimpsest.streaming import log as stream

MAINDOC = b"""<?xml version="1.0"?><DOC xmlns="http://x"><IMAGE name="I" width="128" height="64" x-res="300" colorspacename="RGBA"><layers>
<layer name="top" uuid="{1}" opacity="128" compositeop="multiply" visible="0"/><layer name="group" nodetype="grouplayer"><layers><layer name="inner" filename="layer2"/></layers></layer></layers></IMAGE></DOC>"""


def test_archive_round_trip(spark):
    block = archives.tiled_block([(0, 0, "LZF", b"tileAAAA"), (-64, 0, "LZF", b"tileBBBB")])
    parts = [("f.kra", 0, "mimetype", b"application/x"), ("f.kra", 1, "maindoc.xml", MAINDOC), ("f.kra", 2, "I/layers/layer1", block)]
    packed = archives.pack(spark.createDataFrame(parts, "file string, entry_pos int, entry_path string, content binary"))
    broken = spark.createDataFrame([("bad.kra", b"PK no zip")], "file string, content binary")
    entries = archives.entries(packed.unionByName(broken))
    assert [(r.entry_path, bytes(r.content)) for r in entries.orderBy("entry_pos").collect()] == [(p, c) for _, _, p, c in parts]
    assert [(r.tile_pos, r.x, bytes(r.data)) for r in archives.tiles(entries).orderBy("tile_pos").collect()] == [(0, 0, b"tileAAAA"), (1, -64, b"tileBBBB")]
    assert [(r.name, r.opacity, r.blend, r.visible) for r in archives.layers(entries).orderBy("pos").collect()] == [("top", 128, "multiply", False), ("group", 255, "normal", True), ("inner", 255, "normal", True)]
    assert [(r.width, r.height, r.dpi) for r in archives.images(entries).collect()] == [(128, 64, 300.0)]


def test_hostile_tile_count():
    with pytest.raises(ValueError):
        archives.parse_tiles(b"VERSION 2\nTILEWIDTH 64\nTILEHEIGHT 64\nPIXELSIZE 4\nDATA 99999999999\n")


def test_a_torn_line_ends_the_log(spark, tmp_path):
    lines = [json.dumps({"id": f"c{k}", "parents": [f"c{k - 1}"] if k else [], "branch": "main", "files": [{"path": "a", "status": "M"}]}) for k in range(3)]
    path = tmp_path / "commits.jsonl"
    path.write_text("\n".join([*lines[:2], '{"id":"torn', lines[2]]))
    found = logs.commits(spark, str(path))
    assert [r.id for r in found.orderBy("seq").collect()] == ["c0", "c1"]
    assert logs.changed_files(found).count() == 2
    assert logs.branches(spark, "", found).first().tip == "c1"


@pytest.mark.parametrize(("stored", "want"), [({"version": 1, "cacheMaxBytes": 512 << 20}, 256 << 20), ({"version": 1, "cacheMaxBytes": 7}, 7), ({"version": 2, "cacheMaxBytes": 512 << 20}, 512 << 20), ({}, 256 << 20)])
def test_configuration_moves_the_old_default_only(spark, tmp_path, stored, want):
    path = tmp_path / "config.json"
    path.write_text(json.dumps(stored))
    assert logs.config(spark, str(path)).first().cacheMaxBytes == want


def test_live_tree_passes_over_late_changes(spark, tmp_path):
    folder = str(tmp_path / "log")
    change = lambda seq, content: {"seq": seq, "branch": "b", "message": "", "timestamp": "", "files": [{"path": "p", "status": "M", "content": content, "size": 1}]}
    stream.append_commit(folder, change(5, "new"))
    query = stream.start_live_tree(spark, folder, "live_tree", str(tmp_path / "ck"))
    try:
        query.processAllAvailable()
        stream.append_commit(folder, change(3, "late"))
        query.processAllAvailable()
        stream.append_commit(folder, change(9, "newest"))
        query.processAllAvailable()
        assert [r.content for r in spark.table("live_tree").orderBy("seq").collect()] == ["new", "newest"]
    finally:
        query.stop()


def test_the_newest_result_of_each_layer_stays(spark):
    batch = lambda *rows: spark.createDataFrame(rows, "id string, done long, png string")
    stream.upsert_layers(batch(("a", 2, "a2"), ("b", 1, "b1")), "layer_results")
    stream.upsert_layers(batch(("a", 1, "late"), ("b", 3, "b3"), ("c", 1, "c1")), "layer_results")
    assert sorted((r.id, r.png) for r in spark.table("layer_results").collect()) == [("a", "a2"), ("b", "b3"), ("c", "c1")]
    assert [t.name for t in spark.catalog.listTables() if t.name.startswith("layer_results_")].__len__() == 1


def test_timing_samples(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"op": "commit", "ms": 12.5, "ts": 3, "commitId": "c"}, {"op": "diff", "ms": 1, "ts": 4}]))
    (tmp_path / "b.json").write_text("{no array")
    assert sorted((r.op, r.ms, r.commit_id) for r in logs.samples(spark, str(tmp_path)).collect()) == [("commit", 12.5, "c"), ("diff", 1.0, None)]
