"""Queries of the problems tagged llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, broken, docs, machine, neardup, packing, ranking, truncation
from quarry.sources.tables import cut, table

LISTS = ["bm25", "vector", "rerank"]


def _aggregated(spark: SparkSession, root: str) -> DataFrame:
    return ranking.aggregate_ranks(ranking.search_lists(table(spark, root, "search_rows")), "query_id", "chunk_id", "list", "measure", LISTS)


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return ranking.leaders(_aggregated(spark, root), 5).select("query_id", "chunk_id")


def p3_ranking(spark: SparkSession, root: str) -> DataFrame:
    return ranking.leaders(_aggregated(spark, root)).select("query_id", "chunk_id", F.round("rho", 9).alias("rho"), F.col("position").cast("long").alias("position"))


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return broken.judged_files(table(spark, root, "chunks")).where(~F.col("valid")).select("repo", "file_path")


def p1_rates(spark: SparkSession, root: str) -> DataFrame:
    return broken.broken_rates(broken.judged_files(table(spark, root, "chunks")))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return machine.machine_made(table(spark, root, "chunks")).select("repo", "file_path")


def p2_validation(spark: SparkSession, root: str) -> DataFrame:
    """Held-out figures of the classifier, by repositories it has not seen."""
    _, figures = machine.train(cut(machine.source_files(table(spark, root, "chunks"))))
    return spark.createDataFrame([(k, round(float(v), 6)) for k, v in figures.items()], "figure string, value double")


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return neardup.id_pairs(*neardup.near_duplicates(table(spark, root, "chunks")))


def p6_groups(spark: SparkSession, root: str) -> DataFrame:
    return neardup.groups(*neardup.near_duplicates(table(spark, root, "chunks"))).select(F.col("id").alias("chunk_id"), "class_id", "n_links")


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return docs.documented_functions(table(spark, root, "chunks")).select("chunk_id", "func_name").distinct()


def p7_pairs(spark: SparkSession, root: str) -> DataFrame:
    return docs.documented_functions(table(spark, root, "chunks"))


def p8_ids(spark: SparkSession, root: str) -> DataFrame:
    return bpe.token_ids(table(spark, root, "documents"), "doc_id", "text")


def p9_packing(spark: SparkSession, root: str) -> DataFrame:
    limits, documents = table(spark, root, "pack_limits"), table(spark, root, "documents")
    names = sorted(r[0] for r in limits.select("tokenizer").where("tokenizer is not null").distinct().collect())
    sized = bpe.token_counts(documents, "doc_id", "text", names)
    return packing.pack(spark, cut(sized), limits)


def p9_fill(spark: SparkSession, root: str) -> DataFrame:
    """Per pack: containers, items, tokens and the share of the room that is filled."""
    limits = table(spark, root, "pack_limits").select("pack_name", "capacity_tokens").distinct()
    per = p9_packing(spark, root).groupBy("pack_name", "container_id").agg(F.sum("size").alias("tokens"), F.count("*").alias("items"))
    out = per.groupBy("pack_name").agg(F.count("*").alias("n_containers"), F.sum("items").alias("n_items"), F.sum("tokens").alias("n_tokens"))
    return out.join(F.broadcast(limits), "pack_name").withColumn("filled", F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 6))


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    return truncation.truncated(table(spark, root, "documents")).select("doc_id")


def p10_rates(spark: SparkSession, root: str) -> DataFrame:
    """Per source: documents with text, cut ones and their share."""
    documents = table(spark, root, "documents")
    found = truncation.truncated(documents).groupBy("source").agg(F.count("*").alias("n_cut"))
    every = documents.where(F.length(F.trim("text")) > 0).groupBy("source").agg(F.count("*").alias("n_documents"))
    out = every.join(found, every["source"].eqNullSafe(found["source"]), "left").select(every["source"], "n_documents", F.coalesce("n_cut", F.lit(0)).alias("n_cut"))
    return out.withColumn("share", F.round(F.col("n_cut") / F.col("n_documents"), 6))


_P3 = """
WITH s AS (SELECT query_id, chunk_id, CASE WHEN lower(trim(match_reason)) LIKE '%reranked%' THEN 'rerank' WHEN lower(trim(match_reason)) LIKE 'bm25%' THEN 'bm25'
    WHEN lower(trim(match_reason)) LIKE 'vector%' THEN 'vector' END AS l, score, distance FROM search_rows),
m AS (SELECT query_id, chunk_id, l, max(CASE WHEN l = 'vector' THEN -distance ELSE score END) AS v FROM s
    WHERE l IS NOT NULL AND CASE WHEN l = 'vector' THEN distance ELSE score END IS NOT NULL AND NOT isnan(CASE WHEN l = 'vector' THEN distance ELSE score END) GROUP BY ALL),
k AS (SELECT *, (rank() OVER (PARTITION BY query_id, l ORDER BY v DESC) + (count(*) OVER (PARTITION BY query_id, l, v) - 1) / 2e0) / count(*) OVER (PARTITION BY query_id, l) AS r FROM m),
w AS (SELECT query_id, chunk_id, list_sort([coalesce(min(r) FILTER (WHERE l = 'bm25'), 1e0), coalesce(min(r) FILTER (WHERE l = 'vector'), 1e0), coalesce(min(r) FILTER (WHERE l = 'rerank'), 1e0)]) AS a FROM k GROUP BY ALL),
z AS (SELECT query_id, chunk_id, least(1e0, 3 * least(1 - (1 - a[1]) ** 3, 3 * a[2] ** 2 * (1 - a[2]) + a[2] ** 3, a[3] ** 3)) AS rho, ln(a[1]) + ln(a[2]) + ln(a[3]) AS strength FROM w),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rho, 12), round(strength, 12), chunk_id) AS position FROM z)
"""


_P6 = """
WITH c AS (SELECT DISTINCT id, lower(content) AS t FROM chunks WHERE coalesce(trim(parent_chunk_id), '') = '' AND id IS NOT NULL AND content IS NOT NULL),
w AS (SELECT id, word, count(*) AS c FROM (SELECT id, unnest(regexp_extract_all(t, '[a-z0-9_]+')) AS word FROM c) GROUP BY ALL),
z AS (SELECT id, sum(c) AS n FROM w GROUP BY id HAVING sum(c) >= 50),
v AS (SELECT w.id, word, c, n FROM w JOIN z USING (id)),
s AS (SELECT a.id AS x, b.id AS y, any_value(a.n) AS na, any_value(b.n) AS nb, sum(least(a.c, b.c)) AS common FROM v a JOIN v b ON a.word = b.word AND a.id < b.id AND a.n >= 0.8e0 * b.n AND b.n >= 0.8e0 * a.n GROUP BY a.id, b.id)
SELECT x AS chunk_id_a, y AS chunk_id_b FROM s WHERE common / (na + nb - common) >= 0.8e0"""


def queries() -> dict:
    return {"p1_found": p1_found, "p1_rates": p1_rates, "p2_found": p2_found, "p2_validation": p2_validation, "p3_found": p3_found, "p3_ranking": p3_ranking, "p6_found": p6_found, "p6_groups": p6_groups, "p7_found": p7_found, "p7_pairs": p7_pairs, "p8_ids": p8_ids, "p9_packing": p9_packing, "p9_fill": p9_fill, "p10_found": p10_found, "p10_rates": p10_rates}


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": _P3 + "SELECT query_id, chunk_id FROM p WHERE position <= 5",
        "p6_found": _P6,
        "p3_ranking": _P3 + "SELECT query_id, chunk_id, round(rho, 9) AS rho, position FROM p",
    }
