"""Files of a git repository: listings on the driver, contents read by the executors."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.search import EXCLUDES, excluded
from quarry.sources.session import map_arrow

SECONDS = 30


def _git(place: str, *args: str) -> bytes | None:
    """The output of a git command; None where there is no git or no repository, or it takes longer than SECONDS."""
    try:
        done = subprocess.run(["git", "-C", place, *args], capture_output=True, timeout=SECONDS, check=False)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout if done.returncode == 0 else None


def working_files(spark: SparkSession, place: str) -> DataFrame | None:
    """(file_path) of the tracked files and of those that are neither tracked nor ignored, in order; None if there is no repository."""
    out = _git(place, "ls-files", "-z", "--cached", "--others", "--exclude-standard")
    if out is None:
        return None
    names = sorted({n.decode("utf-8", "replace") for n in out.split(b"\0") if n})
    return spark.createDataFrame([(n,) for n in names], "file_path string")


def committed_files(spark: SparkSession, place: str, at: str = "HEAD", excludes: list[str] | None = None) -> DataFrame | None:
    """(file_path, content_hash) of the files of a commit, the hash being the object's name; links and submodules are left out."""
    out = _git(place, "ls-tree", "-r", "-z", at)
    if out is None:
        return None
    rows = []
    for line in out.split(b"\0"):
        if line:
            kind, path = line.split(b"\t", 1)
            mode, what, name = kind.decode().split()
            if what == "blob" and mode != "120000":
                rows.append((path.decode("utf-8", "replace"), name))
    return spark.createDataFrame(sorted(rows), "file_path string, content_hash string").where(~excluded(F.col("file_path"), EXCLUDES if excludes is None else excludes))


def changed_since(spark: SparkSession, place: str, before: str, at: str = "HEAD") -> DataFrame | None:
    """(file_path, action) of the files that differ between two commits; None if the first is not among the ancestors of the second."""
    if _git(place, "merge-base", "--is-ancestor", before, at) is None:
        return None
    out = _git(place, "diff", "--name-status", "--no-renames", "-z", before, at)
    if out is None:
        return None
    parts = [x.decode("utf-8", "replace") for x in out.split(b"\0") if x]
    action = {"A": "added", "D": "deleted"}
    return spark.createDataFrame([(p, action.get(s, "changed")) for s, p in zip(parts[::2], parts[1::2], strict=True)], "file_path string, action string")


def identity(place: str) -> dict:
    """root_commits and remote of a repository, as far as it has them."""
    roots, remote = _git(place, "rev-list", "--max-parents=0", "HEAD"), _git(place, "config", "--get", "remote.origin.url")
    return {k: v for k, v in {"root_commits": sorted(roots.decode().split()) if roots else None, "remote": remote.decode().strip() if remote else None}.items() if v}


def with_contents(files: DataFrame, place: str, repo: str) -> DataFrame:
    """(repo, file_path, content_hash, content) for rows of committed_files; `place` must be readable by the executors.

    Each task reads its objects through one process. Bytes that are not UTF-8 are replaced; an object that cannot be read has
    a null content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = subprocess.Popen(["git", "-C", place, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE)
        try:
            for batch in batches:
                texts = []
                for name in batch.column(1).to_pylist():
                    p.stdin.write(f"{name}\n".encode())
                    p.stdin.flush()
                    head = p.stdout.readline().split()
                    if len(head) != 3:
                        texts.append(None)
                        continue
                    texts.append(p.stdout.read(int(head[2])).decode("utf-8", "replace"))
                    p.stdout.read(1)
                yield pa.RecordBatch.from_arrays([pa.array([repo] * batch.num_rows, pa.string()), batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["repo", "file_path", "content_hash", "content"])
        finally:
            p.stdin.close()
            p.wait()

    return map_arrow(files.select("file_path", "content_hash"), run, "repo string, file_path string, content_hash string, content string")
