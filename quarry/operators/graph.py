"""The graph of references: looking symbols up and one-hop expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LOOKUP_CAP, SEEDS, SLOTS = 25, 5, 10


def quality_order(c):
    return F.when(c == "ast", 0).when(c == "regex", 1).when(c == "text_fallback", 2).otherwise(3)


def lookup_symbols(names: DataFrame, symbols: DataFrame, chunks: DataFrame, cap: int = LOOKUP_CAP) -> DataFrame:
    """(repo, name, chunk_id, place): for each (repo, name) its defining chunks, best quality first, at most `cap`; exact names, ties by id.

    The cap is part of the operator; Spark keeps `cap` rows a name and task before the shuffle of the ranking."""
    defs = symbols.where(F.col("removed_at").isNull()).select("repo", F.col("symbol_name").alias("name"), "chunk_id").distinct()
    known = chunks.groupBy(F.col("id").alias("chunk_id")).agg(F.max("search_quality").alias("search_quality"))
    j = names.select("repo", "name").distinct().join(defs, ["repo", "name"]).join(known, "chunk_id")
    w = Window.partitionBy("repo", "name").orderBy(quality_order(F.col("search_quality")), "chunk_id")
    return j.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= cap).select("repo", "name", "chunk_id", "place")


def expand(seeds: DataFrame, present: DataFrame, refs: DataFrame, symbols: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, chunk_id, slot): chunks that the references of a query's seeds lead to and that are not present, SLOTS at most.

    seeds: (query_id, chunk_id, position); present: (query_id, chunk_id). Order: the seed's position, the target's name, the place of the definition."""
    edges = refs.select("repo", F.col("source_chunk_id").alias("chunk_id"), F.col("target_symbol").alias("name")).where("name is not null").distinct()
    wanted = seeds.join(edges, "chunk_id").select("query_id", "position", "repo", "name")
    found = lookup_symbols(wanted, symbols, chunks)
    hits = wanted.join(found, ["repo", "name"]).groupBy("query_id", "chunk_id").agg(F.min(F.struct("position", "name", "place")).alias("o"))
    hits = hits.join(present, ["query_id", "chunk_id"], "left_anti")
    w = Window.partitionBy("query_id").orderBy("o", "chunk_id")
    return hits.withColumn("slot", F.row_number().over(w).cast("long")).where(F.col("slot") <= SLOTS).select("query_id", "chunk_id", "slot")
