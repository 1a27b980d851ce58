"""A versioned working tree whose log, files and objects are Spark tables.

Tables only grow by appended Parquet files; the small mutable state (configuration, branch tips, the
shelf, undone commits) is one JSON file that is replaced atomically, tips last, so a crash leaves the state before.
Every question is answered by DataFrames over the tables; the driver moves file bytes only between the
working tree and the object table, one batch of wanted objects at a time.
"""

from __future__ import annotations

import fcntl
import json
import os
import shutil
import time
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import labels
from palimpsest.operators import diff, document_merge, documents, store, trees
from palimpsest.sources import archives, palettes, worktree

COMMIT = "seq long, id string, message string, author string, timestamp string, parents array<string>, branch string, restored_from string"
FILE = "commit_id string, seq long, path string, status string, content string, size long"
INDEX = "path string, size long, mtime_ns long, content string, read_at long"
OBJECT = "object string, size long, payload binary"
DEFAULTS = {"chain_max": 20, "tile_size": 64, "cache_max_bytes": 256 << 20, "tile_pixel_deltas": False, "low_memory_diff": False}
INVALID = '/\\:*?"<>|'


class RepositoryError(Exception):
    """Any refusal of a repository."""


class Locked(RepositoryError):
    """Another process changes the repository."""


class NotFound(RepositoryError):
    """A branch, commit, stash or file that is not there."""


class NothingToDo(RepositoryError):
    """The operation would change nothing."""


class DirtyTree(RepositoryError):
    """The working tree has changes that the operation would lose."""


class Repository:
    """A repository at a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.home = spark, root, os.path.join(root, worktree.STORE)
        if not self.is_repository(root):
            raise NotFound(f"no repository at {root}")

    # ---- state

    @staticmethod
    def is_repository(root: str) -> bool:
        return os.path.exists(os.path.join(root, worktree.STORE, "state.json"))

    @classmethod
    def init(cls, spark: SparkSession, root: str) -> Repository:
        above = os.path.abspath(root)
        while True:
            if cls.is_repository(above):
                raise RepositoryError(f"{above} is a repository already")
            if above == os.path.dirname(above):
                break
            above = os.path.dirname(above)
        os.makedirs(os.path.join(root, worktree.STORE))
        cls._put(os.path.join(root, worktree.STORE), {"config": DEFAULTS, "current": "main", "tips": {"main": None}, "stashes": [], "undone": [], "next": 1})
        return cls(spark, root)

    @staticmethod
    def _put(home: str, state: dict) -> None:
        with open(os.path.join(home, "state.json.tmp"), "w") as out:
            json.dump(state, out)
        os.replace(os.path.join(home, "state.json.tmp"), os.path.join(home, "state.json"))

    def _state(self) -> dict:
        with open(os.path.join(self.home, "state.json")) as f:
            return json.load(f)

    def _holder(self) -> str:
        """Which repository is locked, for what, and since when."""
        name, sidecar = os.path.basename(os.path.abspath(self.root)) or self.root, os.path.join(self.home, "lock.info")
        try:
            with open(sidecar) as f:
                doing = f.read() or "writing"
            seconds = max(0, int(time.time() - os.stat(sidecar).st_mtime))
        except OSError:
            return f"{name} — writing"
        age = f"{seconds}s" if seconds < 60 else f"{seconds // 60}m" if seconds < 3600 else f"{seconds // 3600}h"
        return f"{name} — {doing} for {age}"

    @contextmanager
    def _locked(self, doing: str = "writing") -> Iterator[dict]:
        """The state to change; it is put back only if nothing was raised."""
        with open(os.path.join(self.home, "lock"), "w") as handle:
            try:
                fcntl.flock(handle, fcntl.LOCK_EX | fcntl.LOCK_NB)
            except BlockingIOError:
                raise Locked(self._holder()) from None
            with open(os.path.join(self.home, "lock.info"), "w") as info:
                info.write(doing)
            state = self._state()
            yield state
            self._put(self.home, state)

    def config(self) -> dict:
        return self._state()["config"]

    def set_config(self, **changes: object) -> None:
        if unknown := set(changes) - set(DEFAULTS):
            raise RepositoryError(f"no such setting: {', '.join(sorted(unknown))}")
        with self._locked("changing settings") as state:
            state["config"] |= changes

    def delete(self) -> None:
        with self._locked("deleting the repository"):
            pass
        shutil.rmtree(self.home)

    def export_zip(self, target: str) -> None:
        """The working tree and the store in one zip."""
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
            for folder, _, names in os.walk(self.root):
                for name in names:
                    full = os.path.join(folder, name)
                    if os.path.abspath(full) != os.path.abspath(target):
                        out.write(full, os.path.relpath(full, self.root))

    @staticmethod
    def export_many(spark: SparkSession, roots: list[str], folder: str) -> list[str]:
        """A zip `<folder name>-<day>.zip` for each repository; those that fail are returned, the others go on."""
        failed, day = [], time.strftime("%Y-%m-%d", time.gmtime())
        for root in roots:
            try:
                Repository(spark, root).export_zip(os.path.join(folder, f"{os.path.basename(os.path.abspath(root))}-{day}.zip"))
            except (OSError, RepositoryError, zipfile.LargeZipFile):
                failed.append(root)
        return failed

    # ---- tables

    def _table(self, name: str, schema: str) -> DataFrame:
        path = os.path.join(self.home, name)
        return self.spark.read.schema(schema).parquet(path) if os.path.isdir(path) else self.spark.createDataFrame([], schema)

    def _append(self, df: DataFrame, name: str) -> None:
        df.write.mode("append").parquet(os.path.join(self.home, name))

    def commits(self) -> DataFrame:
        """The whole log in append order (seq), undone commits left out."""
        undone = self._state()["undone"]
        return self._table("commits", COMMIT).where(~F.col("id").isin(undone) if undone else F.lit(True))

    def files(self) -> DataFrame:
        """The changed paths of all commits."""
        return self._table("files", FILE)

    def objects(self) -> DataFrame:
        return self._table("objects", OBJECT)

    def _reachable(self, tips: list[str]) -> DataFrame:
        """(ancestor): every commit id that a tip reaches over any parent."""
        edges = self.commits().select("id", F.explode_outer("parents").alias("parent"))
        starts = self.spark.createDataFrame([(t,) for t in tips], "id string")
        return trees.ancestors(edges, starts)

    def log(self, branch: str | None = None) -> DataFrame:
        """Commits that the branch's tip reaches, with their version in append order; newest first."""
        tip = self._tip(branch)
        if tip is None:
            return self.commits().limit(0).withColumn("version", F.lit(0).cast("long"))
        reached = self._reachable([tip]).select(F.col("ancestor").alias("id"))
        return trees.numbered(self.commits().join(reached, "id", "left_semi"), "seq").orderBy(F.desc("seq"))

    def branches(self) -> DataFrame:
        state = self._state()
        return self.spark.createDataFrame([(n, t, n == state["current"]) for n, t in sorted(state["tips"].items())], "name string, tip string, is_current boolean")

    def _tip(self, branch: str | None = None) -> str | None:
        state = self._state()
        name = branch or state["current"]
        if name not in state["tips"]:
            raise NotFound(f"no branch {name}")
        return state["tips"][name]

    def tree(self, commit: str | None) -> DataFrame:
        """(path, seq, status, content, size): the files of a commit, folded along first parents."""
        if commit is None:
            return self.files().limit(0).drop("commit_id")
        log = self.commits()
        if log.where(F.col("id") == commit).isEmpty():
            raise NotFound(f"no commit {commit}")
        parents = log.select("id", F.get("parents", F.lit(0)).alias("parent"))
        chain = trees.first_parents(parents, commit)
        changes = self.files().join(chain.select(F.col("ancestor").alias("commit_id")), "commit_id", "left_semi")
        return trees.fold(changes.drop("commit_id"), ("path",))

    # ---- working tree

    def _working(self) -> DataFrame:
        """(path, size, mtime_ns, content) of the working files; those whose size and time are as when they were last read, and
        older than that reading, are not read again."""
        listed = worktree.candidates(worktree.listing(self.spark, self.root), self.tree(self._tip()))
        read_at = time.time_ns()
        path = os.path.join(self.home, "index")
        if os.path.isdir(path):
            seen = self.spark.read.schema(INDEX).parquet(path).select("path", *[F.col(c).alias(f"__{c}") for c in ("size", "mtime_ns", "content", "read_at")])
            both = listed.join(seen, "path", "left")
            reads = F.coalesce(diff.needs_hash(F.col("size"), F.col("mtime_ns"), F.col("__size"), F.col("__mtime_ns"), F.col("__read_at")), F.lit(True))
            both = trees.checkpointed(both.withColumn("__reads", reads))
            known = both.where("not __reads").select("path", "size", "mtime_ns", F.col("__content").alias("content"))
            fresh = worktree.hashed(both.where("__reads").select("path", "size", "mtime_ns"), self.root)
            found = trees.checkpointed(known.unionByName(fresh))
        else:
            found = trees.checkpointed(worktree.hashed(listed, self.root))
        self._keep_index(found.withColumn("read_at", F.lit(read_at).cast("long")))
        return found

    def _keep_index(self, seen: DataFrame) -> None:
        """Replaces the index of what was read; without it a scan reads everything, so a crash in between loses nothing."""
        path = os.path.join(self.home, "index")
        seen.write.mode("overwrite").parquet(f"{path}.new")
        shutil.rmtree(path, ignore_errors=True)
        os.replace(f"{path}.new", path)

    def status(self, paths: list[str] | None = None) -> DataFrame:
        """(path, status) of the working tree against the current tip: U, M or D."""
        found = diff.scan_status(self._working(), self.tree(self._tip()))
        return found if paths is None else found.where(F.col("path").isin(paths) if paths else F.lit(False))

    def _restore(self, plan: DataFrame) -> None:
        """Makes the working tree follow (path, status, content): D deletes, others are written."""
        plan = trees.checkpointed(plan)  # it may be made from the very files that change below
        for row in plan.where("status = 'D'").select("path").toLocalIterator():
            full = os.path.join(self.root, row["path"])
            if os.path.exists(full):
                os.remove(full)
        wanted = plan.where("status <> 'D'").select("path", F.col("content").alias("object"))
        for row in wanted.join(self.objects().dropDuplicates(["object"]), "object", "left").select("path", "object", "payload").toLocalIterator():
            if row["payload"] is None:
                raise NotFound(f"object {row['object']} of {row['path']} is missing")
            full = os.path.join(self.root, row["path"])
            os.makedirs(os.path.dirname(full), exist_ok=True)
            with open(f"{full}.tmp", "wb") as out:
                out.write(row["payload"])
            os.replace(f"{full}.tmp", full)

    def _require_clean(self) -> None:
        if not self.status().isEmpty():
            raise DirtyTree("the working tree has changes")

    def _store(self, paths: DataFrame) -> DataFrame:
        """Stores the bytes of working files (path) and gives (path, content, size) back."""
        root = self.root

        def load(batches):  # noqa: ANN001, ANN202
            for batch in batches:
                payloads = []
                for path in batch["path"]:
                    with open(os.path.join(root, path), "rb") as f:
                        payloads.append(f.read())
                yield batch.assign(payload=payloads)

        loaded = paths.select("path").mapInPandas(load, "path string, payload binary")
        loaded = trees.checkpointed(loaded.select("path", F.sha2("payload", 256).alias("content"), F.octet_length("payload").cast("long").alias("size"), "payload"))
        new = store.dead(loaded.select(F.col("content").alias("object"), "size", "payload").dropDuplicates(["object"]), self.objects())
        self._append(new, "objects")
        return loaded.select("path", "content", "size")

    # ---- mutations

    def _record(self, state: dict, changed: DataFrame, message: str, author: str, parents: list[str], restored_from: str | None = None) -> str:
        """Appends a commit of `changed` (path, status, content, size) and moves the current tip to it."""
        changed = trees.checkpointed(changed)
        digest = changed.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "path", F.coalesce("content", F.lit("-"))))), "\n"), 256)).first()[0]
        timestamp = time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())
        ident = self.spark.range(1).select(labels.content_id([F.lit(x) for x in (timestamp, message, ",".join(parents), digest, str(state["next"]))])).first()[0]
        row = (state["next"], ident, message, author, timestamp, parents, state["current"], restored_from)
        self._append(changed.select(F.lit(ident).alias("commit_id"), F.lit(state["next"]).cast("long").alias("seq"), "path", "status", "content", F.col("size").cast("long").alias("size")), "files")
        self._append(self.spark.createDataFrame([row], COMMIT), "commits")
        state["next"] += 1
        state["tips"][state["current"]] = ident
        return ident

    def commit(self, message: str, author: str, paths: list[str] | None = None) -> str:
        with self._locked("committing") as state:
            found = trees.checkpointed(self.status(paths))
            if found.isEmpty():
                raise NothingToDo("nothing has changed")
            stored = self._store(found.where("status <> 'D'"))
            status = F.when(F.col("status") == "U", "A").otherwise(F.col("status"))
            changed = found.join(stored, "path", "left").select("path", status.alias("status"), "content", "size")
            tip = state["tips"][state["current"]]
            return self._record(state, changed, message, author, [tip] if tip else [])

    def create_branch(self, name: str, base: str | None = None) -> None:
        """Makes a branch at the tip of `base` (or the current branch) and goes to it; only another base needs a clean tree."""
        name = name.strip()
        if not 1 <= len(name.encode()) <= 60 or any(c in INVALID or ord(c) < 32 or ord(c) == 127 for c in name):
            raise RepositoryError(f"not a branch name: {name!r}")
        with self._locked("creating a branch") as state:
            if name in state["tips"]:
                raise RepositoryError(f"{name} is there already")
            tip = self._tip(base)
            if base not in (None, state["current"]):
                self._require_clean()
                self._restore(diff.tree_changes(self.tree(self._tip()), self.tree(tip)))
            state["tips"][name] = tip
            state["current"] = name

    def delete_branch(self, name: str) -> None:
        with self._locked("deleting a branch") as state:
            if name == state["current"]:
                raise RepositoryError("the current branch stays")
            if state["tips"].pop(name, self) is self:
                raise NotFound(f"no branch {name}")

    def switch(self, name: str) -> None:
        with self._locked("switching branch") as state:
            target = self._tip(name)
            self._require_clean()
            self._restore(diff.tree_changes(self.tree(self._tip()), self.tree(target)))
            state["current"] = name

    def merge(self, source: str, author: str) -> str:
        """Fast-forwards where it can, else commits a three-way merge; a conflict takes the source and is marked C."""
        with self._locked("merging") as state:
            if source == state["current"]:
                raise RepositoryError("a branch is not merged into itself")
            ours, theirs = state["tips"][state["current"]], self._tip(source)
            self._require_clean()
            if theirs is None:
                raise NothingToDo("the source has no commits")
            reach = trees.checkpointed(self._reachable([t for t in (ours, theirs) if t]))
            has = lambda start, ident: not reach.where((F.col("start") == start) & (F.col("ancestor") == ident)).isEmpty()
            if ours and has(ours, theirs):
                raise NothingToDo("the source is merged already")
            if ours is None or has(theirs, ours):
                self._restore(diff.tree_changes(self.tree(ours), self.tree(theirs)))
                state["tips"][state["current"]] = theirs
                return theirs
            both = reach.groupBy("ancestor").agg(F.count_distinct("start").alias("n")).where("n = 2").select(F.col("ancestor").alias("id"))
            base = self.commits().join(both, "id", "left_semi").agg(F.max_by("id", "seq")).first()[0]
            current, other = self.tree(ours), self.tree(theirs)
            changed = trees.checkpointed(diff.three_way(self.tree(base), current, other))
            sizes = current.select("content", "size").unionByName(other.select("content", "size")).dropDuplicates(["content"])
            self._restore(changed)
            return self._record(state, changed.join(sizes, "content", "left").select("path", "status", "content", "size"), f"Merge {source} into {state['current']}", author, [ours, theirs])

    def rollback(self, commit: str, author: str) -> str:
        """Commits the tree of an earlier commit again."""
        with self._locked("restoring a version") as state:
            tip, target = state["tips"][state["current"]], self.tree(commit)
            plan = trees.checkpointed(diff.tree_changes(self.tree(tip), target))
            self._restore(diff.tree_changes(self._working(), target))
            if plan.isEmpty():
                if commit == tip:
                    return tip
                raise NothingToDo("that tree is here already")
            changed = plan.join(target.select("path", "size"), "path", "left").select("path", "status", "content", "size")
            return self._record(state, changed, f"Restore {commit}", author, [tip], commit)

    def undo(self) -> str | None:
        """Takes the tip off the log; the working tree stays as it is."""
        with self._locked("undoing a commit") as state:
            tip = state["tips"][state["current"]]
            if tip is None:
                return None
            row = self.commits().where(F.col("id") == tip).first()
            used = not self.commits().where(F.array_contains("parents", tip)).isEmpty() or sum(t == tip for t in state["tips"].values()) > 1
            if used or len(row["parents"]) > 1:
                raise RepositoryError("other commits or branches stand on it")
            state["tips"][state["current"]] = row["parents"][0] if row["parents"] else None
            state["undone"].append(tip)
            return tip

    def discard(self, paths: list[str] | None = None) -> None:
        """Gives up working changes: new files go, others come back."""
        with self._locked("discarding changes"):
            found = self.status(paths).join(self.tree(self._tip()).select("path", "content"), "path", "left")
            self._restore(trees.checkpointed(found.select("path", F.when(F.col("status") == "U", "D").otherwise("M").alias("status"), "content")))

    def restore_file(self, path: str, commit: str) -> None:
        """Writes a file as that commit changed it; a commit that did not touch it does not have it."""
        with self._locked("restoring a file"):
            found = self.files().where((F.col("commit_id") == commit) & (F.col("path") == path) & F.col("content").isNotNull())
            if found.isEmpty():
                raise NotFound(f"{commit} does not change {path}")
            self._restore(found.select("path", "status", "content"))

    # ---- shelf

    def stash(self, author: str, label: str = "", paths: list[str] | None = None) -> str:
        with self._locked("setting work aside") as state:
            found = trees.checkpointed(self.status(paths))
            if found.isEmpty():
                raise NothingToDo("nothing has changed")
            stored = self._store(found.where("status <> 'D'"))
            rows = found.join(stored, "path", "left").orderBy("path").collect()  # the user's own changes in one working tree
            ident = self.spark.range(1).select(labels.content_id([F.lit(x) for x in (time.time_ns(), label, len(state["stashes"]))])).first()[0]
            state["stashes"].append({"id": ident, "label": label, "author": author, "branch": state["current"], "files": [[r["path"], r["status"], r["content"]] for r in rows]})
            back = found.join(self.tree(self._tip()).select("path", "content"), "path", "left")
            self._restore(trees.checkpointed(back.select("path", F.when(F.col("status") == "U", "D").otherwise("M").alias("status"), "content")))
            return ident

    def stashes(self) -> DataFrame:
        """Newest first."""
        rows = [(k, s["id"], s["label"], s["author"], s["branch"], len(s["files"])) for k, s in enumerate(self._state()["stashes"])]
        return self.spark.createDataFrame(rows, "seq long, id string, label string, author string, branch string, files long").orderBy(F.desc("seq"))

    def pop_stash(self, ident: str) -> None:
        """Puts a stash back. Of paths that changed meanwhile, documents get the stashed layers that differ from the current tip's
        on top of their own; any other such path refuses the whole, before anything is written."""
        with self._locked("bringing work back") as state:
            entry = next((s for s in state["stashes"] if s["id"] == ident), None)
            if entry is None:
                raise NotFound(f"no stash {ident}")
            plan = self.spark.createDataFrame([tuple(f) for f in entry["files"]], "path string, status string, content string")
            hit = trees.checkpointed(plan.join(self.status().select("path"), "path", "left_semi"))
            drawn = F.lower("path").endswith(".kra") & (F.col("status") != "D")
            refused = hit.where(~drawn).agg(F.array_join(F.array_sort(F.collect_list("path")), ", ")).first()[0]
            if refused:
                raise DirtyTree(f"changed meanwhile: {refused}")
            merged = self._merged_layers(hit)
            problem = merged.where("content is null").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(": ", "file", "problem"))), ", ")).first()[0]
            if problem:
                raise RepositoryError(problem)
            self._restore(plan.join(hit.select("path"), "path", "left_anti"))
            for row in merged.toLocalIterator():
                full = os.path.join(self.root, row["file"])
                with open(f"{full}.tmp", "wb") as out:
                    out.write(row["content"])
                os.replace(f"{full}.tmp", full)
            state["stashes"].remove(entry)

    def _merged_layers(self, stashed: DataFrame) -> DataFrame:
        """(file, content, problem): working documents with the stashed ones' layers."""
        root = self.root

        def load(batches):  # noqa: ANN001, ANN202
            for batch in batches:
                found = []
                for path in batch["file"]:
                    full = os.path.join(root, path)
                    if os.path.isfile(full):
                        with open(full, "rb") as f:
                            found.append(f.read())
                    else:
                        found.append(b"")
                yield batch.assign(base=found)

        rows = self._payloads(stashed).withColumnRenamed("content", "incoming")
        rows = rows.mapInPandas(load, "file string, incoming binary, base binary")
        before = self._payloads(self.tree(self._tip()).join(stashed.select("path"), "path", "left_semi")).withColumnRenamed("content", "ancestor")
        return trees.checkpointed(document_merge.merged_documents(rows.join(before, "file", "left")))

    def drop_stash(self, ident: str | None = None) -> int:
        """Drops one stash, or all."""
        with self._locked("dropping set-aside work") as state:
            kept = [s for s in state["stashes"] if ident is not None and s["id"] != ident]
            dropped = len(state["stashes"]) - len(kept)
            if ident is not None and not dropped:
                raise NotFound(f"no stash {ident}")
            state["stashes"] = kept
            return dropped

    # ---- reports

    def _payloads(self, files: DataFrame) -> DataFrame:
        """(file, content): the bytes of files (path, content), content by hash."""
        wanted = files.where("content is not null").select(F.col("path").alias("file"), F.col("content").alias("object"))
        return wanted.join(self.objects().dropDuplicates(["object"]), "object").select("file", F.col("payload").alias("content"))

    def _tracked(self, commit: str, path: str) -> DataFrame:
        found = self.tree(commit).where(F.col("path") == path)
        if found.isEmpty():
            raise NotFound(f"{path} is not in {commit}")
        return self._payloads(found)

    def _working_payload(self, path: str) -> DataFrame:
        if not self.spark.range(1).select(labels.safe_path(F.lit(path))).first()[0]:
            raise RepositoryError(f"not a path of the working tree: {path}")
        full = os.path.join(self.root, path)
        if not os.path.isfile(full):
            return self.spark.createDataFrame([], "file string, content binary")
        with open(full, "rb") as f:
            return self.spark.createDataFrame([(path, f.read())], "file string, content binary")

    @staticmethod
    def _side(files: DataFrame) -> dict[str, DataFrame]:
        """What a comparison needs of documents (file, content), committed or working."""
        entries = trees.checkpointed(archives.entries(files))
        return {"entries": entries, "tiles": archives.tiles(entries), "layers": archives.layers(entries), "images": archives.images(entries)}

    def _versions(self, commit: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The commit's changes, and the bytes of its files before and after."""
        row = self.commits().where(F.col("id") == commit).first()
        if row is None:
            raise NotFound(f"no commit {commit}")
        own = trees.checkpointed(self.files().where(F.col("commit_id") == commit).select("path", "status", "content"))
        before = self.tree(row["parents"][0] if row["parents"] else None).join(own.select("path"), "path", "left_semi").select("path", "content")
        before = trees.checkpointed(before)
        return own.join(before.withColumnRenamed("content", "before"), "path", "left"), self._payloads(before), self._payloads(own)

    @staticmethod
    def _kinds(changes: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
        """`changes` (path, status, ...) with kind: art for a document that can be read, palette for a palette with swatches, else text."""
        art = archives.images(archives.entries(new.where(F.lower("file").endswith(".kra")))).select(F.col("file").alias("path"), F.lit(True).alias("__art"))
        is_palette = F.lower("file").rlike(r"\.(gpl|kpl|aco|ase)$")
        coloured = palettes.swatches(old.unionByName(new).where(is_palette).dropDuplicates(["file", "content"])).select(F.col("file").alias("path"), F.lit(True).alias("__palette")).distinct()
        both = changes.join(art.distinct(), "path", "left").join(coloured, "path", "left")
        kind = F.when(F.col("__art") & (F.col("status") != "D"), "art").when(F.col("__palette"), "palette").otherwise("text")
        return both.withColumn("kind", kind).drop("__art", "__palette")

    def commit_diff(self, commit: str) -> DataFrame:
        """(path, status, before, after, kind) of a commit against its first parent's tree, contents by hash."""
        changes, old, new = self._versions(commit)
        return self._kinds(changes.withColumnRenamed("content", "after"), old, new).select("path", "status", "before", "after", "kind")

    def commit_palettes(self, commit: str) -> DataFrame:
        """(path, status, name, before, after, change, pos): swatches of the palettes that a commit changes; one inside a
        document has the path `document::file`, and is there only if a swatch of it changed."""
        changes, old, new = self._versions(commit)
        return self._palettes(changes.select("path", "status"), old, new)

    def _palettes(self, changes: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
        hexed = lambda side: palettes.swatches(side).select("file", "name", labels.hex_colour(F.col("r"), F.col("g"), F.col("b")).alias("colour"), "pos")
        alone = F.lower("file").rlike(r"\.(gpl|kpl|aco|ase)$")
        found = diff.keyed_list_diff(hexed(old.where(alone)), hexed(new.where(alone)), ["file", "name"], "colour", "pos")
        found = found.join(changes.select(F.col("path").alias("file"), "status"), "file")
        inner = [self._embedded(side.where(F.lower("file").endswith(".kra"))) for side in (old, new)]
        pairs = inner[0].select("file", "key", F.struct("entry", "hash").alias("o")).join(inner[1].select("file", "key", F.struct("entry", "hash").alias("n")), ["file", "key"], "full_outer")
        pairs = pairs.where("not (o.hash <=> n.hash)").withColumn("label", F.concat("file", F.lit("::"), labels.file_name(F.coalesce("n.entry", "o.entry"))))
        sides = []
        for side, version in zip(inner, ("o", "n"), strict=True):
            picked = pairs.select("file", "key", "label", F.col(f"{version}.entry").alias("entry")).join(side.select("file", "key", "content"), ["file", "key"])
            named = hexed(picked.select(F.concat_ws("\0", "label", "entry").alias("file"), "content"))
            sides.append(named.withColumn("file", F.substring_index("file", "\0", 1)))
        within = diff.keyed_list_diff(*sides, ["file", "name"], "colour", "pos")
        status = lambda a, b: F.when(a.isNull(), "A").when(b.isNull(), "D").otherwise("M")
        counts = within.groupBy("file").agg(F.max("before").alias("b"), F.max("after").alias("a"), F.count_if(F.col("change") != "unchanged").alias("n")).where("n > 0")
        within = within.join(counts.select("file", status(F.col("b"), F.col("a")).alias("status")), "file")
        return found.unionByName(within).select(F.col("file").alias("path"), "status", "name", "before", "after", "change", "pos")

    @staticmethod
    def _embedded(files: DataFrame) -> DataFrame:
        """(file, key, entry, hash, content): one entry for each palette inside the documents, a .kpl before others, then the greatest name."""
        inside = archives.entries(files).where(labels.embedded_palette(F.col("entry_path")) & ~F.startswith(F.col("content"), F.lit(b"VERSION ")))
        keyed = inside.select("file", labels.palette_key(F.col("entry_path")).alias("key"), "entry_path", "content")
        best = F.max_by(F.struct(F.col("entry_path").alias("entry"), "content"), F.struct(F.lower("entry_path").endswith(".kpl"), "entry_path")).alias("e")
        return keyed.groupBy("file", "key").agg(best).select("file", "key", "e.entry", F.sha2("e.content", 256).alias("hash"), "e.content")

    def commit_art(self, commit: str) -> DataFrame:
        """The layers of every document that a commit changes, with what happened to each (`documents.art_changes`)."""
        _, old, new = self._versions(commit)
        drawn = F.lower("file").endswith(".kra")
        return documents.art_changes(self._side(old.where(drawn)), self._side(new.where(drawn)))

    def commit_layers(self, commit: str, path: str) -> DataFrame:
        """The layers of one document in a commit, with pictures before and after and the overlay of what changed; no rows
        for what is no document there."""
        _, old, new = self._versions(commit)
        return self._pictures(*(side.where((F.col("file") == path) & F.lower("file").endswith(".kra")) for side in (old, new)))

    def working_diff(self, path: str) -> DataFrame:
        """(path, status, kind) of a working file against the current tip: M where the tip has it, else A."""
        old, new = self._last_committed(path), self._working_payload(path)
        status = "A" if old.isEmpty() else "M"
        return self._kinds(self.spark.createDataFrame([(path, status)], "path string, status string"), old, new)

    def working_art(self, path: str) -> DataFrame:
        """The layers of a working document against the current tip's; nothing is stored."""
        return documents.art_changes(self._side(self._last_committed(path)), self._side(self._working_payload(path)))

    def working_palettes(self, path: str) -> DataFrame:
        old, new = self._last_committed(path), self._working_payload(path)
        status = "A" if old.isEmpty() else "M"
        return self._palettes(self.spark.createDataFrame([(path, status)], "path string, status string"), old, new)

    def working_layers(self, path: str) -> DataFrame:
        """`commit_layers` for a working document against the current tip."""
        return self._pictures(self._last_committed(path), self._working_payload(path))

    def _last_committed(self, path: str) -> DataFrame:
        return self._payloads(self.tree(self._tip()).where(F.col("path") == path))

    def _pictures(self, old: DataFrame, new: DataFrame) -> DataFrame:
        """The layers of `documents.art_changes` with before, after, mask, outline and the changed box (bx, by, bw, bh)."""
        was, now = self._side(old), self._side(new)
        canvas = now["images"]
        shown = lambda side: documents.layer_rasters(side["tiles"], canvas, documents.default_pixels(side["entries"])).select("file", "entry_path", "png")
        rows = documents.art_changes(was, now)
        rows = rows.join(shown(now).withColumnRenamed("png", "after"), ["file", "entry_path"], "left")
        older = shown(was).select("file", F.col("entry_path").alias("old_entry"), F.col("png").alias("__old"))
        rows = rows.join(older, ["file", "old_entry"], "left")
        before = F.when(F.col("change") == "unchanged", F.col("after")).when(F.col("change") != "added", F.col("__old"))
        rows = trees.checkpointed(rows.withColumn("before", before).drop("__old"))
        pairs = rows.where("change = 'modified'").select("file", "id", "place", "before", "after")
        over = documents.overlays(pairs).select("file", "place", "mask", "outline", *[F.col(c).alias(f"b{c}") for c in ("x", "y", "w", "h")])
        return rows.join(over, ["file", "place"], "left")

    def layer_diff(self, path: str, old_commit: str, new_commit: str) -> DataFrame:
        """(place, id, name, change, details): layer metadata of a document in the trees of two commits."""
        sides = [archives.layers(archives.entries(self._tracked(c, path))) for c in (old_commit, new_commit)]
        return diff.layer_changes(*sides)

    def storage(self) -> DataFrame:
        """(seq, stored_bytes, objects): bytes by the commit that first refers to each object."""
        refs = self.files().where("content is not null").select(F.col("content").alias("object"), F.col("seq").alias("order"), "seq")
        return store.attributed_bytes(refs, self.objects().select("object", "size").dropDuplicates(["object"]), "seq")

    def storage_stats(self) -> DataFrame:
        """(id, seq, tree_bytes, tree_files, stored_bytes): for each version of the current branch's first-parent line, what a full
        copy of it would take, and the bytes of the objects that it is the first to refer to."""
        tip = self._tip()
        parents = self.commits().select("id", F.get("parents", F.lit(0)).alias("parent"))
        line = trees.first_parents(parents, tip) if tip else self.spark.createDataFrame([], "start string, ancestor string")
        own = trees.checkpointed(self.files().join(line.select(F.col("ancestor").alias("commit_id")), "commit_id", "left_semi"))
        ends = trees.version_sizes(own.withColumn("branch", F.lit(0))).groupBy("seq").agg(F.max("tree_bytes").alias("tree_bytes"), F.max("tree_files").alias("tree_files"))
        stored = self.storage().select("seq", "stored_bytes")
        named = self.commits().select("id", "seq").join(line.select(F.col("ancestor").alias("id")), "id", "left_semi")
        return named.join(ends, "seq", "left").join(stored, "seq", "left").select("id", "seq", "tree_bytes", "tree_files", F.coalesce("stored_bytes", F.lit(0)).alias("stored_bytes"))

    def storage_savings(self) -> DataFrame:
        """(naive_bytes, actual_bytes, saved_bytes, percent) over the versions of `storage_stats`."""
        totals = self.storage_stats().agg(F.coalesce(F.sum("tree_bytes"), F.lit(0)).alias("naive_bytes"), F.coalesce(F.sum("stored_bytes"), F.lit(0)).alias("actual_bytes"))
        saved = totals.withColumn("saved_bytes", F.greatest(F.lit(0), F.col("naive_bytes") - F.col("actual_bytes")))
        return saved.withColumn("percent", labels.saved_percent(F.col("actual_bytes"), F.col("naive_bytes")))

    def collect_garbage(self, dry_run: bool = True) -> dict[str, int]:
        """Objects that no reachable commit and no stash refers to, and leftovers of interrupted writes that are over an hour old;
        without `dry_run` they are removed."""
        with self._locked("cleaning up") as state:
            tips = [t for t in state["tips"].values() if t]
            reached = self._reachable(tips).select(F.col("ancestor").alias("commit_id")).distinct()
            live = self.files().join(reached, "commit_id", "left_semi").select(F.col("content").alias("object")).where("object is not null")
            stashed = [(f[2],) for s in state["stashes"] for f in s["files"] if f[2]]
            live = live.unionByName(self.spark.createDataFrame(stashed, "object string"))
            kept = trees.checkpointed(self.objects().join(live.distinct(), "object", "left_semi"))
            before = self.objects().agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
            after = kept.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
            if not dry_run and after[0] < before[0]:
                path = os.path.join(self.home, "objects")
                kept.write.parquet(f"{path}.new")
                os.replace(path, f"{path}.old")
                os.replace(f"{path}.new", path)
                shutil.rmtree(f"{path}.old")
            listed = [(os.path.join(worktree.STORE, n), os.stat(os.path.join(self.home, n))) for n in sorted(os.listdir(self.home)) if n.endswith(".tmp")]
            files = self.spark.createDataFrame([(p, i.st_size, i.st_mtime_ns) for p, i in listed], worktree.LISTED)
            stale = documents.stale_temporary(files, [worktree.STORE], time.time_ns()).collect()
            for row in stale if not dry_run else ():
                os.remove(os.path.join(self.root, row["path"]))
            freed = before[1] - after[1] + sum(r["size"] for r in stale)
            return {"objects": before[0], "dead_objects": before[0] - after[0], "temporary_files": len(stale), "freed_bytes": freed}
