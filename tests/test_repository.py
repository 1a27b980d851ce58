"""Repositories in real folders: commits, branches, merges, stashes, garbage."""

from __future__ import annotations

import pytest

from palimpsest.repository import DirtyTree, Locked, NothingToDo, Repository, RepositoryError


@pytest.fixture
def repo(spark, tmp_path):
    root = tmp_path / "work"
    root.mkdir()
    found = Repository.init(spark, str(root))
    found.put = lambda name, data: (root / name).write_bytes(data)
    found.get = lambda name: (root / name).read_bytes() if (root / name).exists() else None
    found.gone = lambda name: (root / name).unlink()
    return found


def status(repo):
    return {r.path: r.status for r in repo.status().collect()}


def test_commits_branches_and_merges(repo):
    repo.put("a.gpl", b"base-a")
    repo.put("b.gpl", b"base-b")
    repo.put("notes.txt", b"not of a supported kind")
    assert status(repo) == {"a.gpl": "U", "b.gpl": "U"}
    first = repo.commit("first", "me")
    assert status(repo) == {}
    with pytest.raises(NothingToDo):
        repo.commit("again", "me")
    repo.create_branch("feature")
    repo.switch("main")
    repo.put("a.gpl", b"main-a")
    repo.commit("edit a", "me")
    repo.switch("feature")
    assert repo.get("a.gpl") == b"base-a"
    repo.put("a.gpl", b"feat-a")
    repo.put("c.gpl", b"new")
    repo.gone("b.gpl")
    repo.commit("feature work", "me")
    repo.switch("main")
    merged = repo.merge("feature", "me")
    assert (repo.get("a.gpl"), repo.get("b.gpl"), repo.get("c.gpl")) == (b"feat-a", None, b"new")
    assert {r.path: r.status for r in repo.commit_diff(merged).collect()} == {"a.gpl": "C", "b.gpl": "D", "c.gpl": "A"}
    assert [r.version for r in repo.log().collect()] == [4, 3, 2, 1]
    with pytest.raises(NothingToDo):
        repo.merge("feature", "me")
    repo.rollback(first, "me")
    assert repo.get("a.gpl") == b"base-a" and repo.get("c.gpl") is None
    with pytest.raises(RepositoryError):
        repo.create_branch("a/b")


def test_undo_discard_and_stash(repo):
    repo.put("a.gpl", b"one")
    repo.commit("one", "me")
    repo.put("a.gpl", b"two")
    two = repo.commit("two", "me")
    assert repo.undo() == two and repo.get("a.gpl") == b"two"
    assert status(repo) == {"a.gpl": "M"}
    shelf = repo.stash("me", "later")
    assert repo.get("a.gpl") == b"one" and repo.stashes().count() == 1
    repo.put("a.gpl", b"three")
    with pytest.raises(DirtyTree):
        repo.pop_stash(shelf)
    repo.discard()
    assert repo.get("a.gpl") == b"one"
    repo.pop_stash(shelf)
    assert repo.get("a.gpl") == b"two" and repo.stashes().count() == 0
    with pytest.raises(DirtyTree):
        repo.create_branch("x")
        repo.switch("main")


def test_garbage_goes_and_history_stays(repo):
    repo.put("a.gpl", b"keep")
    repo.commit("keep", "me")
    repo.create_branch("side")
    repo.put("a.gpl", b"lose this one")
    repo.commit("lose", "me")
    repo.switch("main")
    repo.delete_branch("side")
    assert repo.collect_garbage()["dead_objects"] == 1
    assert repo.collect_garbage(dry_run=False)["freed_bytes"] == len(b"lose this one")
    assert repo.objects().count() == 1 and repo.storage().count() >= 1
    repo.put("a.gpl", b"oops")
    repo.discard()
    assert repo.get("a.gpl") == b"keep"


def test_one_writer_at_a_time(repo):
    with repo._locked(), pytest.raises(Locked):
        repo.set_config(tile_size=32)
    repo.set_config(tile_size=32)
    assert repo.config()["tile_size"] == 32


def test_storage_of_versions(repo):
    repo.put("a.gpl", b"x" * 100)
    repo.commit("one", "me")
    repo.put("a.gpl", b"y" * 300)
    repo.put("b.gpl", b"z" * 50)
    repo.commit("two", "me")
    got = [(r.tree_bytes, r.tree_files, r.stored_bytes) for r in repo.storage_stats().orderBy("seq").collect()]
    assert got == [(100, 1, 100), (350, 2, 350)]
    repo.gone("b.gpl")
    repo.put("a.gpl", b"x" * 100)
    repo.commit("three", "me")
    assert [(r.tree_bytes, r.tree_files, r.stored_bytes) for r in repo.storage_stats().orderBy("seq").collect()] == [*got, (100, 1, 0)]
    row = repo.storage_savings().first()
    assert (row.naive_bytes, row.actual_bytes, row.saved_bytes, row.percent) == (550, 450, 100, 18)


def test_garbage_takes_old_leftovers(repo):
    import os

    leftover = os.path.join(repo.home, "other.json.tmp")
    open(leftover, "w").write("half")
    assert repo.collect_garbage(dry_run=False)["temporary_files"] == 0
    os.utime(leftover, (1, 1))
    assert repo.collect_garbage()["temporary_files"] == 1 and os.path.exists(leftover)
    assert repo.collect_garbage(dry_run=False)["freed_bytes"] == 4 and not os.path.exists(leftover)
