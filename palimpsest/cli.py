"""Command line of a repository: JSON on stdout, {"error": ...} on stderr.

    python -m palimpsest.cli VERB --repo FOLDER [--message M] [--author A] [--paths '["a"]'] [--branch B] [--name N] [--base C] [--label L] [--id I]
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from palimpsest.repository import Repository, RepositoryError


def _rows(df: DataFrame) -> list[dict]:
    return [row.asDict(recursive=True) for row in df.collect()]


def _status(repo: Repository, args: argparse.Namespace) -> dict:
    current = next(b["name"] for b in _rows(repo.branches()) if b["is_current"])
    return {"branch": current, "changes": _rows(repo.status().orderBy("path")), "stashes": repo.stashes().count()}


def _commit(repo: Repository, args: argparse.Namespace) -> dict:
    ident = repo.commit(args.message, args.author, args.paths)
    row = repo.commits().where(f"id = '{ident}'").first()
    return {"id": ident, "message": row["message"], "timestamp": row["timestamp"]}


def _branches(repo: Repository, args: argparse.Namespace) -> dict:
    found = _rows(repo.branches())
    return {"current": next(b["name"] for b in found if b["is_current"]), "branches": found}


def _switch(repo: Repository, args: argparse.Namespace) -> dict:
    repo.switch(args.branch)
    return {"ok": True, "current": args.branch}


def _create_branch(repo: Repository, args: argparse.Namespace) -> dict:
    repo.create_branch(args.name, args.base)
    return {"ok": True, "current": args.name}


def _discard(repo: Repository, args: argparse.Namespace) -> dict:
    repo.discard(args.paths)
    return {"ok": True}


def _stash(repo: Repository, args: argparse.Namespace) -> dict:
    ident = repo.stash(args.author, args.label or "", args.paths)
    row = repo.stashes().where(f"id = '{ident}'").first()
    return {"id": ident, "label": row["label"], "files": row["files"]}


def _stash_pop(repo: Repository, args: argparse.Namespace) -> dict:
    repo.pop_stash(args.id)
    return {"ok": True, "id": args.id}


def _stash_list(repo: Repository, args: argparse.Namespace) -> dict:
    return {"stashes": _rows(repo.stashes())}


#: What each verb runs and which options it cannot do without.
VERBS = {
    "status": (_status, ()),
    "commit": (_commit, ("message", "author")),
    "branches": (_branches, ()),
    "switch": (_switch, ("branch",)),
    "create-branch": (_create_branch, ("name",)),
    "discard": (_discard, ()),
    "stash": (_stash, ("author",)),
    "stash-pop": (_stash_pop, ("id",)),
    "stash-list": (_stash_list, ()),
}


def main(argv: list[str], spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="palimpsest", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("verb", choices=VERBS)
    parser.add_argument("--repo", required=True)
    parser.add_argument("--paths", type=json.loads, help="a JSON array; an empty one names no file, none at all names every file")
    for option in ("message", "author", "branch", "name", "base", "label", "id"):
        parser.add_argument(f"--{option}")
    args = parser.parse_args(argv)
    run, needed = VERBS[args.verb]
    try:
        if missing := [o for o in needed if getattr(args, o) is None]:
            raise RepositoryError(f"{args.verb} needs --{' --'.join(missing)}")
        repo = Repository(spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate(), args.repo)
        print(json.dumps(run(repo, args)))
        return 0
    except (RepositoryError, PySparkException, OSError) as error:
        print(json.dumps({"error": str(error)}), file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
