"""Connected components by alternating star contractions, all steps distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.sources.tables import cut


def _step(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's neighbours to the least of them: greater neighbours (large) or the others (small)."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    j = both.join(least, "a")
    if large:
        out = j.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = j.select("b", "m").unionByName(least.select(F.col("a").alias("b"), "m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.where("a <> b").distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of links (a, b); the root is the least node of its component.

    Large-star and small-star steps alternate until the edges stay the same, which takes about log2 of the longest
    path in rounds; each round's edges are written to the shared folder and only two numbers come to the driver.
    Not converging within `rounds` raises. Self-links give no node."""
    edges, seen = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()), None
    for _ in range(rounds):
        edges = cut(_step(_step(edges, True), False))
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        seen = now
    raise RuntimeError("components did not converge")
