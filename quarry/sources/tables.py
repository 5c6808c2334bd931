"""Parquet sources and the checkpoint location shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from quarry.sources.session import ship


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir).

    Where the session names none, a temporary folder serves if driver and executors are one process; on a cluster
    that is an error, as no other machine could read it."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        place = f"file://{os.path.join(tempfile.gettempdir(), 'quarry-checkpoint')}"
        spark.conf.set("spark.checkpoint.dir", place)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(place)
    return place


def cut(df: DataFrame) -> DataFrame:
    """df written as a table in the shared folder and read back: lineage ends there and losing an executor costs no recomputation.

    Every call has a folder of its own, so that two plans never share one; it is removed when the application ends."""
    spark = df.sparkSession
    place = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(place)
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(place)
