"""Files put together from their whole chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assemble(parts: list) -> str:
    """The text of a file from (start_line, end_line, content) in order, with blank lines in the gaps."""
    out: list[str] = []
    line = 1
    for part in parts:
        start, content = part["start_line"] or line, part["content"] or ""
        if start > line:
            out.append("\n" * (start - line - 1))
            line = start
        out.append(content)
        line += content.count("\n") + 1
    return "\n".join(out) + "\n" if out else ""


def file_parts(chunks: DataFrame) -> DataFrame:
    """(repo, file_path, parts): per file the distinct (start_line, end_line, content) of its whole chunks, in order.

    A file is the unit of work and is read whole by one task; the shuffle is by repo and path, so a repository with
    a third of all rows spreads over its files. Null paths are one file per repo; null contents are empty."""
    whole = chunks.where(F.coalesce(F.trim("parent_chunk_id"), F.lit("")) == "")
    part = F.struct("start_line", "end_line", "content")
    return whole.groupBy("repo", "file_path").agg(F.array_sort(F.collect_set(part)).alias("parts"))
