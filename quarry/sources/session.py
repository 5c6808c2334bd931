"""What a session needs before Python functions of this package run on its executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application; they need no copy of the repository."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    fd, name = tempfile.mkstemp(prefix="quarry-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    spark.sparkContext.addPyFile(name)
    _shipped.add(app)


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow for functions of this package: whatever df was read by, the executors have the package first."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)
