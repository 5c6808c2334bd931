"""One ranking from several differently scaled scores, by robust rank aggregation."""

from __future__ import annotations

from functools import reduce
from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.ranks import spread_rank


def significance(ranks: list[Column]) -> Column:
    """The corrected minimum of the beta order-statistic probabilities of normalised ranks (each in (0, 1]).

    With the ranks sorted ascending, the k-th of n is as small as r or smaller with probability
    sum_{j>=k} C(n,j) r^j (1-r)^(n-j) when ranks are random; the least of these times n, at most 1, is returned.
    """
    n = len(ranks)
    s = F.array_sort(F.array(*ranks))

    def tail(k: int) -> Column:
        r = F.element_at(s, k)
        return reduce(lambda a, b: a + b, [comb(n, j) * F.pow(r, F.lit(j)) * F.pow(1 - r, F.lit(n - j)) for j in range(k, n + 1)])

    tails = [tail(k) for k in range(1, n + 1)]
    return F.least(F.lit(1.0), n * (F.least(*tails) if n > 1 else tails[0]))


def aggregate_ranks(df: DataFrame, group: str, item: str, listed: str, measure: str, lists: list[str]) -> DataFrame:
    """group, item, rho, strength for every item of a group that stands in at least one of the lists.

    `listed` names the list of a row, `measure` is better the larger it is, whatever its scale. Rows of other
    lists, null groups or items, and null or NaN measures are left out; an item repeated in a list counts by its
    best measure; tied items share the mean of their ranks. Ranks are divided by the length of the list, and an
    item missing from a list has rank 1 there, as has every item where a group lacks the list. `rho` is the
    significance (smaller is better), `strength` the sum of the logarithms of the normalised ranks (breaks ties).
    """
    m = F.col(measure).cast("double")
    rows = (
        df.where(F.col(listed).isin(lists) & F.col(group).isNotNull() & F.col(item).isNotNull() & m.isNotNull() & ~F.isnan(m))
        .groupBy(F.col(group).alias("group"), F.col(item).alias("item"), F.col(listed).alias("list"))
        .agg((-F.max(m)).alias("cost"))
    )
    ranked = spread_rank(rows, ["group", "list"], "cost")
    tied = ranked.groupBy("group", "list", "cost", "rank", "n").agg(F.count("*").alias("ties")).where("ties > 1").select("group", "list", "cost", "ties")
    at = ranked.join(tied, ["group", "list", "cost"], "left").withColumn("r", (F.col("rank") + (F.coalesce("ties", F.lit(1)) - 1) / 2) / F.col("n"))
    wide = at.groupBy("group", "item").agg(*[F.coalesce(F.min(F.when(F.col("list") == x, F.col("r"))), F.lit(1.0)).alias(f"r{i}") for i, x in enumerate(lists)])
    r = [F.col(f"r{i}") for i in range(len(lists))]
    return wide.select(
        F.col("group").alias(group), F.col("item").alias(item), significance(r).alias("rho"), reduce(lambda a, b: a + b, [F.log(x) for x in r]).alias("strength")
    )


def search_lists(rows: DataFrame) -> DataFrame:
    """rows with `list` (rerank, bm25, vector or null) and `measure`, larger is better, from match_reason."""
    reason = F.lower(F.trim("match_reason"))
    kind = F.when(reason.contains("reranked"), "rerank").when(reason.startswith("bm25"), "bm25").when(reason.startswith("vector"), "vector")
    return rows.select("query_id", "chunk_id", kind.alias("list"), F.when(kind == "vector", -F.col("distance")).otherwise(F.col("score")).alias("measure"))


def leaders(df: DataFrame, k: int | None = None) -> DataFrame:
    """Of aggregate_ranks' output per query: position by significance, then strength, then chunk_id; the first k.

    With k each task keeps its k best before anything is shuffled; without, a query of any size is ranked in ranges."""
    if k is not None:
        w = Window.partitionBy("query_id").orderBy(F.round("rho", 12), F.round("strength", 12), "chunk_id")
        return df.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)
    return spread_rank(df.withColumn("_rho", F.round("rho", 12)).withColumn("_strength", F.round("strength", 12)), ["query_id"], "_rho", "_strength", "chunk_id").withColumnRenamed("rank", "position").drop("_rho", "_strength", "n")
