"""Fusing ranked lists into results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.search import RRF_K, quality_factor


def list_ranks(rows: DataFrame, group: list[str], item: str, order: Column) -> DataFrame:
    """rows with `rank`, 1-based by `order` then item, one row per item."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(order, item)))


def reciprocal(full_text: DataFrame, vector: DataFrame, symbol: DataFrame, weighted: bool = True, bonus: bool = True) -> DataFrame:
    """(query_id, chunk_id, score, reason) from ranked lists with query_id, chunk_id, rank, search_quality.

    Each list gives 1 / (15 + rank), each symbol row 1 / 16; the sum is multiplied by the quality factor after that.
    Reasons are joined in the order bm25, vector, symbol."""
    tag = lambda df, name, part: df.select("query_id", "chunk_id", "search_quality", F.lit(name).alias("source"), part.alias("part"))
    share = F.lit(1.0) / (RRF_K + F.col("rank"))
    lists = tag(full_text, "bm25", share).unionByName(tag(vector, "vector", share))
    if bonus:
        lists = lists.unionByName(tag(symbol, "symbol", F.lit(1.0 / (RRF_K + 1))))
    has = lambda s: F.max(F.when(F.col("source") == s, F.lit(s)))
    out = lists.groupBy("query_id", "chunk_id").agg(
        F.sum("part").alias("sum"), F.max("search_quality").alias("search_quality"), F.concat_ws("+", has("bm25"), has("vector"), has("symbol")).alias("reason")
    )
    score = F.col("sum") * (quality_factor(F.col("search_quality")) if weighted else F.lit(1.0))
    return out.select("query_id", "chunk_id", score.alias("score"), "reason")


def full_text_only(full_text: DataFrame, symbol: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score, reason) where there are no vectors: the greatest of BM25 and the constant symbol score, times quality."""
    rows = full_text.select("query_id", "chunk_id", "search_quality", "score", F.lit(1).alias("b"), F.lit(0).alias("s")).unionByName(
        symbol.select("query_id", "chunk_id", "search_quality", F.lit(100.0).alias("score"), F.lit(0).alias("b"), F.lit(1).alias("s"))
    )
    out = rows.groupBy("query_id", "chunk_id").agg(
        F.max("score").alias("score"), F.max("search_quality").alias("q"), F.max(F.when(F.col("b") == 1, F.col("score"))).alias("bm"), F.max("b").alias("b"), F.max("s").alias("s")
    )
    joined = (F.col("s") == 1) & (F.coalesce("bm", F.lit(-1.0)) < 100.0)
    reason = F.when((F.col("b") == 1) & joined, "bm25+symbol").when(F.col("b") == 1, "bm25").otherwise("symbol_exact")
    return out.select("query_id", "chunk_id", (F.col("score") * quality_factor(F.col("q"))).alias("score"), reason.alias("reason"))


def top(df: DataFrame, k: Column, group: str = "query_id", item: str = "chunk_id") -> DataFrame:
    """The k best rows per group with their `position`; ties by item."""
    w = Window.partitionBy(group).orderBy(F.round("score", 10).desc(), item)
    return df.withColumn("position", F.row_number().over(w).cast("long")).where(F.col("position") <= k)


def rerank_by_place(df: DataFrame) -> DataFrame:
    """The stand-in reranker: 1 less a hundredth of the place; `+reranked` joins the reason."""
    return df.withColumn("score", 1.0 - 0.01 * (F.col("position") - 1)).withColumn("reason", F.when(F.col("reason") == "", "reranked").otherwise(F.concat("reason", F.lit("+reranked"))))


def normalised(df: DataFrame, group: str) -> DataFrame:
    """score divided by the greatest of its group where that is positive."""
    best = df.groupBy(group).agg(F.max("score").alias("best"))
    return df.join(best, group).withColumn("score", F.when(F.col("best") > 0, F.col("score") / F.col("best")).otherwise(F.col("score"))).drop("best")


def fill(placed: DataFrame, more: DataFrame, k: Column) -> DataFrame:
    """placed (query_id, chunk_id, score, reason, position) and, behind it, the chunks of `more` (query_id, chunk_id, slot) in the order of their slots, up to position k.

    Those that stand in placed already, at any position, are left out; they have no score of their own."""
    last = placed.where(F.col("position") <= k).groupBy("query_id").agg(F.max("position").alias("last"))
    new = more.join(placed.where(F.col("position") <= k).select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti").join(last, "query_id")
    new = new.withColumn("position", (F.col("last") + F.row_number().over(Window.partitionBy("query_id").orderBy("slot"))).cast("long"))
    new = new.select("query_id", "chunk_id", F.lit(0.0).alias("score"), F.lit("graph_expansion").alias("reason"), "position")
    return placed.select("query_id", "chunk_id", "score", "reason", "position").where(F.col("position") <= k).unionByName(new.where(F.col("position") <= k))
