"""python -m quarry.cli: index a folder, ask an index, show its status, list indexes, clean up."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from quarry.engine import Index, catalogue
from quarry.sources.config import settings
from quarry.sources.discover import scan_files
from quarry.sources.git import identity


def render(rows: list[dict], form: str) -> str:
    """json: all fields; files: distinct paths in order; plain: one line a result."""
    if form == "json":
        return json.dumps(rows, ensure_ascii=False, indent=1)
    if form == "files":
        return "\n".join(dict.fromkeys(r["file_path"] for r in rows))
    return "\n".join(f"{r['score']:.4f} {r['repo']}:{r['file_path']}:{r['start_line']}-{r['end_line']} {r['symbol_name']} [{r['match_reason']}]" for r in rows)


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quarry")
    p.add_argument("--index", required=True, help="folder of the index")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("build", "refresh"):
        s = sub.add_parser(name)
        s.add_argument("folder")
        s.add_argument("--repo", required=True)
        s.add_argument("--branch", default="")
    s = sub.add_parser("ask")
    s.add_argument("question")
    s.add_argument("--top-k", type=int)
    s.add_argument("--branch")
    s.add_argument("--repo")
    s.add_argument("--form", choices=("json", "files", "plain"), default="plain")
    sub.add_parser("status")
    sub.add_parser("list", help="every index in the folder")
    sub.add_parser("clean", help="removes old and unfinished versions")
    a = p.parse_args(args)
    index = Index(SparkSession.builder.appName("quarry").getOrCreate(), a.index, settings=settings())
    if a.command in ("build", "refresh"):
        given = index.settings = settings(a.folder)
        files = scan_files(index.spark, a.folder, a.repo, list(given.exclude_patterns), given.max_file_size)
        whose = identity(a.folder)
        print(json.dumps(index.build(files, a.branch, whose) if a.command == "build" else index.refresh(files, a.branch or None, whose)))
    elif a.command == "ask":
        if len(a.question) > 10_000:
            p.error("the question is longer than 10,000 characters")
        rows = [r.asDict() for r in index.query(a.question, settings(top_k=a.top_k).top_k, a.branch, a.repo).collect()]
        print(render(rows, a.form))
    elif a.command == "list":
        print(json.dumps(catalogue(index.spark, a.index), indent=1))
    elif a.command == "clean":
        print(json.dumps(index.clean()))
    else:
        print(json.dumps(index.status()))
    return 0


if __name__ == "__main__":
    sys.exit(main())
