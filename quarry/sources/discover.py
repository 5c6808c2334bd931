"""Files of a directory tree as a DataFrame."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.search import EXCLUDES, excluded

MAX_FILE_SIZE = 100_000


def scan_files(spark: SparkSession, place: str, repo: str, excludes: list[str] | None = None, max_size: int = MAX_FILE_SIZE) -> DataFrame:
    """(repo, file_path, content, content_hash, mtime_ns) of the files under `place` that are not excluded, empty or above max_size.

    The listing and reading are Spark's binaryFile source; sizes are checked before contents are read. Bytes that
    are not UTF-8 are replaced. The hash is that of the bytes."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(place)
    root = place.rstrip("/") + "/"
    path = F.regexp_replace("path", f"^.*?{_quoted(root)}", "")
    kept = rows.where((F.col("length") > 0) & (F.col("length") <= max_size)).withColumn("file_path", path)
    kept = kept.where(~excluded(F.col("file_path"), excludes if excludes is not None else EXCLUDES))
    return kept.select(
        F.lit(repo).alias("repo"), "file_path", F.decode("content", "UTF-8").alias("content"), F.sha2("content", 256).alias("content_hash"),
        (F.unix_micros(F.col("modificationTime").cast("timestamp")) * 1000).alias("mtime_ns"),
    )


def _quoted(root: str) -> str:
    return re.escape(re.sub(r"^\w+:/+", "/", root))
