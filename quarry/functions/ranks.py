"""Ranks within groups of which one may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.sources.tables import cut


def spread_rank(df: DataFrame, group: list[str], *measure: str) -> DataFrame:
    """df with `rank` (1-based, ties share the lowest) by the measures ascending within `group`, and `n`, the group's rows.

    Neither groups nor measures are null. Equal rows become one with their number by a partial sum; what is left is
    laid out by ranges of (group, measures), so a group of any size spreads over as many tasks as it needs. Each
    range is ranked by itself and the rows of the group's lower ranges are added: one plan, exact for groups of any
    size. The ranges are written before use, so a lost task finds the same ones."""
    distinct = df.groupBy(*group, *measure).agg(F.count("*").alias("_m"))
    laid = cut(distinct.repartitionByRange(*group, *measure).withColumn("_part", F.spark_partition_id()))
    w = Window.partitionBy(*group)
    parts = laid.groupBy(*group, "_part").agg(F.sum("_m").alias("_s"))
    parts = parts.select(*group, "_part", (F.sum("_s").over(w.orderBy("_part")) - F.col("_s")).alias("_below"), F.sum("_s").over(w).alias("n"))
    before = F.sum("_m").over(Window.partitionBy(*group, "_part").orderBy(*measure).rowsBetween(Window.unboundedPreceding, -1))
    placed = laid.withColumn("_before", F.coalesce(before, F.lit(0))).join(parts, [*group, "_part"])
    return df.join(placed.select(*group, *measure, (F.col("_below") + F.col("_before") + 1).alias("rank"), "n"), [*group, *measure]).select(*df.columns, "rank", "n")
