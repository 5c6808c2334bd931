"""Queries of the general problems with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.orphans import dangling, dangling_by_period
from quarry.operators.packed import split_packed
from quarry.sources.tables import table


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    t = lambda n: table(spark, root, n)
    return dangling(t("refs"), t("chunks"), t("symbol_lookup")).select("table_name", "field_name", "row_key")


def p4_by_period(spark: SparkSession, root: str) -> DataFrame:
    t = lambda n: table(spark, root, n)
    return dangling_by_period(t("refs"), t("chunks"), t("symbol_lookup"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return split_packed(table(spark, root, "chunks"), "id", "branches", "loaded_at", at_least=2).select(
        F.col("key").alias("chunk_id"), "pos", F.col("value").alias("branch")
    )


def p5_branch_counts(spark: SparkSession, root: str) -> DataFrame:
    rows = split_packed(table(spark, root, "chunks"), "id", "branches", "loaded_at")
    return rows.groupBy(F.col("value").alias("branch")).agg(F.countDistinct("key").alias("n_chunks"), F.max("pos").alias("last_pos"))


_P4 = r"""
WITH r AS (SELECT ref_id, repo, source_chunk_id, target_symbol, min(seen_at) AS ts FROM refs GROUP BY ALL),
c AS (SELECT id, parent_chunk_id, min(indexed_at) AS ts FROM chunks GROUP BY ALL),
ids AS (SELECT DISTINCT lower(trim(id)) AS k FROM chunks),
syms AS (SELECT DISTINCT repo, lower(trim(symbol_name)) AS k FROM symbol_lookup WHERE removed_at IS NULL AND trim(symbol_name) <> ''),
tgt AS (SELECT ref_id, repo, ts, trim(regexp_replace(regexp_replace(lower(trim(target_symbol)), '^@', ''), '\(\)$', '')) AS t FROM r WHERE trim(target_symbol) <> ''),
parts AS (SELECT DISTINCT repo, t, string_split_regex(t, '\.|\\|/|::') AS a, regexp_extract_all(t, '\.|\\|/|::') AS s FROM tgt),
ends AS (SELECT repo, t, unnest(list_transform(range(1, len(a) + 1), lambda i: a[i] || array_to_string(list_transform(range(i + 1, len(a) + 1), lambda j: s[j - 1] || a[j]), ''))) AS k FROM parts),
met AS (SELECT DISTINCT e.repo, e.t FROM ends e JOIN syms s ON e.repo = s.repo AND e.k = s.k),
every AS (
  SELECT 'refs' AS table_name, 'source_chunk_id' AS field_name, CAST(ref_id AS VARCHAR) AS row_key, ts, lower(trim(source_chunk_id)) NOT IN (SELECT k FROM ids) AS lost FROM r WHERE trim(source_chunk_id) <> ''
  UNION ALL SELECT 'chunks', 'parent_chunk_id', id, ts, lower(trim(parent_chunk_id)) NOT IN (SELECT k FROM ids) FROM c WHERE trim(parent_chunk_id) <> ''
  UNION ALL SELECT 'refs', 'target_symbol', CAST(g.ref_id AS VARCHAR), ts, m.t IS NULL FROM tgt g LEFT JOIN met m ON g.repo = m.repo AND g.t = m.t)
"""
_P5 = r"""
WITH one AS (SELECT id, arg_max(coalesce(branches, ''), loaded_at) AS b FROM chunks GROUP BY id),
tok AS (SELECT id, regexp_extract_all(b, '"(?:[^"]|"")*"|''(?:[^'']|'''')*''|[^\s,;|]+') AS a FROM one),
val AS (SELECT id, list_filter(list_transform(list_transform(a, lambda x: trim(x, '[]{}() ')),
  lambda x: CASE WHEN regexp_full_match(x, '"(?:[^"]|"")*"') THEN replace(x[2:-2], '""', '"') WHEN regexp_full_match(x, '''(?:[^'']|'''')*''') THEN replace(x[2:-2], '''''', '''') ELSE trim(x, '"'' ') END), lambda x: x <> '') AS v
  FROM (SELECT id, list_filter(a, lambda x: true) AS a FROM tok))
"""


def queries() -> dict:
    return {"p4_found": p4_found, "p4_by_period": p4_by_period, "p5_found": p5_found, "p5_branch_counts": p5_branch_counts}


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": _P4 + "SELECT DISTINCT table_name, field_name, row_key FROM every WHERE lost",
        "p4_by_period": _P4 + """SELECT table_name, field_name, strftime(ts, '%Y-%m') AS period, CAST(count(*) AS BIGINT) AS n_references, CAST(count(*) FILTER (WHERE lost) AS BIGINT) AS n_dangling,
            round(count(*) FILTER (WHERE lost) / CAST(count(*) AS DOUBLE), 6) AS share FROM every GROUP BY ALL""",
        "p5_found": _P5 + "SELECT id AS chunk_id, CAST(unnest(range(1, len(v) + 1)) AS INTEGER) AS pos, unnest(v) AS branch FROM val WHERE len(v) >= 2",
        "p5_branch_counts": _P5 + """SELECT branch, count(DISTINCT id) AS n_chunks, max(pos) AS last_pos FROM
            (SELECT id, CAST(unnest(range(1, len(v) + 1)) AS INTEGER) AS pos, unnest(v) AS branch FROM val) GROUP BY branch""",
    }
