"""Incremental upkeep as a stream of file states."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.index import latest
from quarry.sources.tables import shared_dir


def _versions(spark: SparkSession, base: str) -> list[int]:
    """The numbers of the states under base that were written whole, ascending."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(base)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(path)]
    whole = lambda n: fs.exists(jvm.org.apache.hadoop.fs.Path(f"{base}/{n}/_SUCCESS"))
    return sorted(int(n[6:]) for n in names if n.startswith("state-") and n[6:].isdigit() and whole(n))


def _identity(spark: SparkSession, source: str) -> str:
    """What a source is known by: a folder, to which files come, by its path; a single file also by its size and time, as another file may take its place."""
    path = spark._jvm.org.apache.hadoop.fs.Path(source)
    status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
    return source if status.isDirectory() else f"{source}|{status.getLen()}|{status.getModificationTime()}"


def refresh_stream(
    spark: SparkSession, source: str, keys: list[str], order: list[str], every: str | None = None, base: str | None = None, files_a_batch: int | None = None, keep: int = 2
) -> DataFrame:
    """The last state per key of all rows that have arrived under `source`, kept by a stream.

    Each micro-batch is merged into the state before its number, found on disk, and written as the state of its number:
    a batch that is run again after a failure reads the same state and writes the same result, and a stream that is
    started again goes on where it stopped. `base` is the folder of progress and states, by default one in the shared
    folder that belongs to this source (a single file replaced by another is a new source); states but the last `keep` are removed. Without `every` all that is there is taken
    and the stream ends; with it (say `300 seconds`) the stream takes what is there, batch by batch, and the state so far is
    returned. An empty source gives no rows."""
    base = base or f"{shared_dir(spark)}/refresh-{hashlib.sha256('|'.join([_identity(spark, source), *keys, *order]).encode()).hexdigest()[:16]}"
    schema = spark.read.parquet(source).schema

    def merge(batch: DataFrame, number: int) -> None:
        before = [v for v in _versions(spark, base) if v < number]
        rows = batch.select(*schema.names)
        if before:
            rows = rows.unionByName(spark.read.schema(schema).parquet(f"{base}/state-{before[-1]}"))
        latest(rows, keys, order).write.mode("overwrite").parquet(f"{base}/state-{number}")
        for old in before[: max(0, len(before) + 1 - keep)]:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/state-{old}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    pattern = f"{source[:-1]}[{source[-1]}]"  # a pattern may name a single file as well as a folder
    reader = spark.readStream.schema(schema)
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    writer = reader.parquet(pattern).writeStream.foreachBatch(merge).option("checkpointLocation", f"{base}/progress")
    stream = (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
    if every:
        stream.processAllAvailable()
        stream.stop()
    else:
        stream.awaitTermination()
    known = _versions(spark, base)
    return spark.read.schema(schema).parquet(f"{base}/state-{known[-1]}") if known else spark.createDataFrame([], schema)


def stale_files(state: DataFrame, now_ns: int, age_ns: int) -> DataFrame:
    """Files whose state is older than `age_ns`, or of unknown age."""
    return state.where(F.col("mtime_ns").isNull() | (F.lit(now_ns) - F.col("mtime_ns") > age_ns))
