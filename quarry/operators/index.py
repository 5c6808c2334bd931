"""Keeping an index: differences between snapshots, upserts, deletes, branches, status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the last by `order`; ties by the other columns. One hash shuffle, partial before it."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    row = F.max(F.struct(*order, *rest))
    out = df.groupBy(*keys).agg(row.alias("_r"))
    return out.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in df.columns])


def difference(stored: DataFrame, current: DataFrame, keys: list[str], hashed: str, forced: DataFrame | None = None) -> DataFrame:
    """keys and `action` (added, changed, unchanged, deleted) by one full outer join; forced keys count as changed."""
    j = stored.select(*keys, F.col(hashed).alias("_s"), F.lit(1).alias("_in_s")).join(current.select(*keys, F.col(hashed).alias("_c"), F.lit(1).alias("_in_c")), keys, "full")
    if forced is not None:
        j = j.join(forced.select(*keys, F.lit(True).alias("_f")).distinct(), keys, "left")
    else:
        j = j.withColumn("_f", F.lit(None).cast("boolean"))
    same = F.col("_s").eqNullSafe(F.col("_c")) & F.col("_f").isNull()
    return j.select(*keys, F.when(F.col("_in_s").isNull(), "added").when(F.col("_in_c").isNull(), "deleted").when(same, "unchanged").otherwise("changed").alias("action"))


def fast_difference(stored: DataFrame, current: DataFrame, keys: list[str], mtime: str, hashed: str) -> DataFrame:
    """As difference, but files whose modification time is known and equal are unchanged without a look at the hash."""
    s = stored.select(*keys, F.col(mtime).alias("_m"), F.col(hashed).alias("_s"))
    c = current.select(*keys, F.col(mtime).alias("_n"), F.col(hashed).alias("_c"), F.lit(1).alias("_in"))
    j = s.withColumn("_at", F.lit(1)).join(c, keys, "full")
    action = F.when(F.col("_at").isNull(), "added").when(F.col("_in").isNull(), "deleted").when(F.col("_m") == F.col("_n"), "unchanged_mtime").when(F.col("_s").eqNullSafe(F.col("_c")), "unchanged_hash").otherwise("changed")
    return j.select(*keys, action.alias("action"))


def union_branches(df: DataFrame, keys: list[str], branches: str) -> DataFrame:
    """keys and the sorted set of all branches (comma-separated lists) under each key."""
    e = df.select(*keys, F.explode_outer(F.split(branches, ",")).alias("b"))
    return e.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("b") != "", F.col("b")))), ",").alias("branches"))


def on_branch(df: DataFrame, branches: str, branch: str) -> DataFrame:
    """Rows without branches or with this one among them."""
    b = F.coalesce(F.col(branches), F.lit(""))
    return df.where((b == "") | F.array_contains(F.split(b, ","), branch))


def delete_files(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of a table that do not belong to deleted files or chunks."""
    return table.join(gone.select(*keys).distinct(), keys, "left_anti")
