from __future__ import annotations

import json

from palimpsest.cli import main
from palimpsest.repository import Repository


def test_verbs_print_json(spark, tmp_path, capsys):
    Repository.init(spark, str(tmp_path))
    (tmp_path / "a.gpl").write_bytes(b"one")

    def call(*argv):
        code = main([argv[0], "--repo", str(tmp_path), *argv[1:]], spark)
        out = capsys.readouterr()
        return code, json.loads(out.out or out.err.strip().splitlines()[-1])

    assert call("status") == (0, {"branch": "main", "changes": [{"path": "a.gpl", "status": "U"}], "stashes": 0})
    assert call("commit", "--message", "m")[1]["error"] == "commit needs --author"
    assert call("commit", "--message", "m", "--author", "a", "--paths", "[]")[0] == 1
    assert call("commit", "--message", "m", "--author", "a")[1]["message"] == "m"
    assert call("create-branch", "--name", "side")[1] == {"ok": True, "current": "side"}
    assert call("branches")[1]["current"] == "side"
    (tmp_path / "a.gpl").write_bytes(b"two")
    stash = call("stash", "--author", "a", "--label", "x")[1]
    assert stash["files"] == 1 and call("stash-list")[1]["stashes"][0]["id"] == stash["id"]
    assert call("stash-pop", "--id", stash["id"])[0] == 0 and (tmp_path / "a.gpl").read_bytes() == b"two"
    assert call("discard")[1] == {"ok": True} and (tmp_path / "a.gpl").read_bytes() == b"one"
    assert call("switch", "--branch", "none")[0] == 1
