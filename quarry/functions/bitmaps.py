"""A bitmap of hashed keys: rows that none of them can match are told apart before a shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.sources.tables import cut

#: Words of 64 bits (8 MB), whatever the number of keys.
MAP_WORDS = 1 << 19


def _place(h: str) -> Column:
    return F.shiftrightunsigned(F.col(h), 6).bitwiseAND(MAP_WORDS - 1)


def _bit(h: str) -> Column:
    return F.expr(f"shiftleft(1L, cast({h} & 63 as int))")


def bitmap(keys: DataFrame) -> DataFrame:
    """(_place, _bits) of the 64-bit hashes `h`: at most MAP_WORDS rows."""
    return keys.groupBy(_place("h").alias("_place")).agg(F.bit_or(_bit("h")).alias("_bits"))


def maybe(df: DataFrame, bits: DataFrame) -> DataFrame:
    """The rows of df whose h is, or by chance may be, in the bitmap, which is all that travels to the executors."""
    return df.withColumn("_place", _place("h")).join(F.broadcast(bits), "_place").where(F.col("_bits").bitwiseAND(_bit("h")) != 0).drop("_place", "_bits")


def never(df: DataFrame, bits: DataFrame) -> DataFrame:
    """The rows of df that maybe() leaves out."""
    met = F.coalesce(F.col("_bits").bitwiseAND(_bit("h")) != 0, F.lit(False))
    return df.withColumn("_place", _place("h")).join(F.broadcast(bits), "_place", "left").where(~met).drop("_place", "_bits")


def once(rows: DataFrame, keys: list[str], merge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """merge(rows), which makes one of rows of the same keys and leaves others as they are: only the rows of repeated keys are shuffled and merged, and written; the others stay where they are read."""
    hashed = rows.withColumn("h", F.xxhash64(*keys))
    bits = cut(bitmap(hashed.groupBy("h").agg(F.count("*").alias("_n")).where("_n > 1")))
    return never(hashed, bits).drop("h").unionByName(cut(merge(maybe(hashed, bits).drop("h"))))
