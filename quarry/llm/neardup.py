"""Near-duplicate chunks: pairs and the groups they form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.components import components
from quarry.llm.minhash import SIGNED, signed, similar_pairs
from quarry.sources.session import map_arrow
from quarry.sources.tables import cut

THRESHOLD, LEAST_WORDS = 0.8, 50


def whole_chunks(chunks: DataFrame) -> DataFrame:
    """Rows without parent, null contents and ids left out."""
    whole = chunks.where(F.coalesce(F.trim("parent_chunk_id"), F.lit("")) == "")
    return whole.where(F.col("id").isNotNull() & F.col("content").isNotNull())


def bodies(chunks: DataFrame) -> DataFrame:
    """(id, h, text) of the whole chunks; h is a hash of the text."""
    return whole_chunks(chunks).select("id", F.xxhash64("content").alias("h"), F.col("content").alias("text"))


def signed_chunks(chunks: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """SIGNED rows of the whole chunks with at least `least` words, written to the shared folder.

    Rows delivered twice stay: they are made one where they are used."""
    return cut(map_arrow(bodies(chunks), signed(least), SIGNED))


def near_duplicates(chunks: DataFrame, threshold: float = THRESHOLD, least: int = LEAST_WORDS) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): members has id, d1, d2; pairs the similar digests. Equal word multisets share a digest.

    Words are runs of a-z, 0-9 and _ in the lower-cased text, similarity is that of the multisets. Texts with
    fewer than `least` words are no members; of an id that came with several texts the one of the least digest counts.
    The whole text counts, of any length.
    """
    rows = signed_chunks(chunks, least)
    members = rows.groupBy("id").agg(F.min(F.struct("d1", "d2")).alias("d")).select("id", "d.d1", "d.d2")
    return members, similar_pairs(rows, bodies(chunks), threshold)


def id_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(chunk_id_a, chunk_id_b): every pair of different ids, the smaller first, also those of equal texts."""
    m = lambda x: members.select(F.col("id").alias(f"id_{x}"), F.col("d1").alias(f"{x}1"), F.col("d2").alias(f"{x}2"))
    near = pairs.join(m("a"), ["a1", "a2"]).join(m("b"), ["b1", "b2"]).select("id_a", "id_b")
    same = members.select(F.col("id").alias("id_a"), "d1", "d2").join(members.select(F.col("id").alias("id_b"), "d1", "d2"), ["d1", "d2"]).where("id_a < id_b")
    every = near.unionByName(same.select("id_a", "id_b"))
    return every.select(F.least("id_a", "id_b").alias("chunk_id_a"), F.greatest("id_a", "id_b").alias("chunk_id_b"))


def groups(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """id, class_id, n_links: the least id of its group and the number of other ids at least as similar as the threshold.

    Only links between representatives are followed; copies are never expanded into pairs."""
    rep = cut(members.groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    r = lambda x: rep.select(F.col("rep").alias(f"rep_{x}"), F.col("copies").alias(f"copies_{x}"), F.col("d1").alias(f"{x}1"), F.col("d2").alias(f"{x}2"))
    links = cut(pairs.select("a1", "a2", "b1", "b2").join(r("a"), ["a1", "a2"]).join(r("b"), ["b1", "b2"]).select("rep_a", "rep_b", "copies_a", "copies_b"))
    found = components(links.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")))
    degree = (
        links.select(F.col("rep_a").alias("rep"), F.col("copies_b").alias("m")).unionByName(links.select(F.col("rep_b").alias("rep"), F.col("copies_a").alias("m")))
        .groupBy("rep").agg(F.sum("m").alias("m"))
    )
    per = rep.join(degree, "rep", "left").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    per = per.select("d1", "d2", F.coalesce("root", "rep").alias("class_id"), (F.coalesce("m", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return members.join(per, ["d1", "d2"]).select("id", "class_id", "n_links")
