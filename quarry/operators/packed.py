"""Several values packed in one field: one row per value with its position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import packed_values


def split_packed(df: DataFrame, key: str, field: str, order: str | None = None, at_least: int = 1) -> DataFrame:
    """(key, pos, value): the values packed in `field` of each key, pos from 1.

    Keys delivered more than once give one row set, from the row with the greatest `order` (or the greatest
    text where no order is given). Null, empty and blank fields give nothing; repeated values all count;
    keys with fewer than `at_least` values are left out; null keys are no keys. Only a hash shuffle of
    (key, field) for the de-duplication, partial before it; the splitting itself stays in generated code.
    """
    rows = df.select(F.col(key).alias("key"), F.col(field).alias("packed"), (F.col(order) if order else F.col(field)).alias("ord")).where(
        F.col("key").isNotNull()
    )
    latest = rows.groupBy("key").agg(F.max(F.struct("ord", "packed"))["packed"].alias("packed"))
    values = latest.select("key", packed_values(F.col("packed")).alias("values")).where(F.size("values") >= at_least)
    return values.select("key", F.posexplode("values").alias("pos", "value")).select("key", (F.col("pos") + 1).alias("pos"), "value")
