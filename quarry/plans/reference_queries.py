"""The engine's own queries with their SQL: retrieval, fusion, graph, chunking, index upkeep and status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.bitmaps import once
from quarry.functions.search import ACCENTED, EXCLUDES, PLAIN, chunk_id, excluded, symbol_candidates, symbol_weight
from quarry.operators import bm25, fusion, graph, index, vectors
from quarry.sources.tables import table

_ALL: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _ALL[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(_ALL)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# Full-text search.

_FOLD = "regexp_extract_all(translate(lower(coalesce({0}, '')), '" + ACCENTED + "', '" + PLAIN + "'), '[\\p{{L}}\\p{{N}}]+')"


def _bm25_sql(rows: str, queries_sql: str, limit: int, columns: list[str]) -> str:
    """BM25 in SQL over `rows` (grp, key and the columns) for `queries_sql` (query_id, grp, query_text)."""
    cols = " UNION ALL ".join(f"SELECT grp, key, {i} AS col, {_FOLD.format(c)} AS t FROM src" for i, c in enumerate(columns))
    return f"""
WITH src AS ({rows}), toks AS ({cols}),
post AS (SELECT grp, key, col, unnest(range(0, len(t))) AS pos, unnest(t) AS term FROM toks WHERE len(t) > 0),
sizes AS (SELECT grp, key, sum(len(t)) AS dl FROM toks GROUP BY grp, key),
stats AS (SELECT grp, count(*) AS n, avg(dl) AS avgdl FROM sizes GROUP BY grp),
qs AS ({queries_sql}),
ws AS (SELECT query_id, grp, list_filter(list_transform(list_filter(regexp_split_to_array(coalesce(query_text, ''), '\\s+'), lambda w: w <> ''),
  lambda w: {_FOLD.format("regexp_replace(translate(w, '\"''*^', ''), '^-+', '')")}), lambda t: len(t) > 0) AS p FROM qs),
ph AS (SELECT query_id, grp, len(p) AS n_phrases, unnest(range(0, len(p))) AS phrase, unnest(p) AS t FROM ws WHERE len(p) > 0),
qt AS (SELECT query_id, grp, n_phrases, phrase, len(t) AS n_terms, unnest(range(0, len(t))) AS off, unnest(t) AS term FROM ph),
starts AS (SELECT query_id, q.grp, n_phrases, phrase, n_terms, key, col, pos - off AS start, count(*) AS met FROM post JOIN qt q ON post.grp = q.grp AND post.term = q.term GROUP BY ALL),
found AS (SELECT query_id, grp, n_phrases, phrase, key, count(*) AS f FROM starts WHERE met = n_terms GROUP BY ALL),
dfs AS (SELECT query_id, phrase, count(*) AS df FROM found GROUP BY ALL),
sc AS (SELECT query_id, n_phrases, key, sum(CASE WHEN ln((n - df + 0.5e0) / (df + 0.5e0)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5e0) / (df + 0.5e0)) END
  * f * 2.2e0 / (f + 1.2e0 * (0.25e0 + 0.75e0 * dl / avgdl))) AS score, count(*) AS met
  FROM found JOIN dfs USING (query_id, phrase) JOIN sizes USING (grp, key) JOIN stats USING (grp) GROUP BY query_id, n_phrases, key),
rk AS (SELECT query_id, key, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, key) AS rank FROM sc WHERE met = n_phrases)
SELECT query_id, key, round(score, 8) AS score, rank FROM rk WHERE rank <= {limit}"""


def _documents_search(spark: SparkSession, root: str, text: str, limit: int = 30) -> DataFrame:
    d = table(spark, root, "documents").where("text is not null")
    all_of = F.lit(0)
    q = spark.createDataFrame([(0, 0, text)], "query_id int, grp int, query_text string")
    out = bm25.search(bm25.postings(d, all_of, "doc_id", ["text"]), bm25.lengths(d, all_of, "doc_id", ["text"]), q, limit)
    return out.select("query_id", "key", F.round("score", 8).alias("score"), "rank")


def _documents_sql(text: str) -> str:
    return _bm25_sql("SELECT 0 AS grp, doc_id AS key, text FROM documents WHERE text IS NOT NULL", f"SELECT 0 AS query_id, 0 AS grp, '{text}' AS query_text", 30, ["text"])


@query(_documents_sql("snapshot"))
def bm25_single_term(spark, root):
    return _documents_search(spark, root, "snapshot")


@query(_documents_sql("snapshot digest"))
def bm25_multi_term_and(spark, root):
    return _documents_search(spark, root, "snapshot digest")


@query(_documents_sql("full-table needs"))
def bm25_phrase(spark, root):
    return _documents_search(spark, root, "full-table needs")


_CHUNK_ROWS = "SELECT repo AS grp, id AS key, max(content) AS content, max(file_path) AS file_path, max(symbol_name) AS symbol_name FROM chunks GROUP BY repo, id"


@query(_bm25_sql(_CHUNK_ROWS, "SELECT query_id, repo AS grp, query_text FROM queries", 10, ["content", "file_path", "symbol_name"]))
def bm25_query_batch(spark, root):
    """Every row of `queries` against the chunks of its repository, statistics per repository."""
    return _batch_search(spark, root, 10).select("query_id", "key", F.round("score", 8).alias("score"), "rank")


def _batch_search(spark: SparkSession, root: str, limit: int) -> DataFrame:
    cols = ["content", "file_path", "symbol_name"]
    c = once(table(spark, root, "chunks").select("repo", "id", *cols), ["repo", "id"], lambda x: x.groupBy("repo", "id").agg(*[F.max(c).alias(c) for c in cols]))
    q = table(spark, root, "queries").select("query_id", F.col("repo").alias("grp"), "query_text")
    return bm25.scan(c, F.col("repo"), "id", cols, q, limit)


# Vectors.


def _first_vector(spark: SparkSession, root: str) -> list[float]:
    return [float(x) for x in table(spark, root, "embeddings").where("vec_id = 0").first()["embedding"]]


_VEC = """WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0),
d AS (SELECT vec_id AS key, {0} AS distance FROM embeddings, q),
r AS (SELECT key, round(distance, 6) AS distance, row_number() OVER (ORDER BY round(distance, 10), key) AS rank FROM d)
SELECT key, distance, rank FROM r WHERE rank <= {1}"""


@query(_VEC.format("list_distance(embedding::DOUBLE[], v)", 90))
def knn_l2_top90(spark, root):
    out = vectors.nearest(table(spark, root, "embeddings"), "vec_id", "embedding", _first_vector(spark, root), 90)
    return out.withColumn("distance", F.round("distance", 6))


@query(_VEC.format("1 - list_cosine_similarity(embedding::DOUBLE[], v)", 30))
def knn_cosine_top30(spark, root):
    out = vectors.nearest(table(spark, root, "embeddings"), "vec_id", "embedding", _first_vector(spark, root), 30, "cosine")
    return out.withColumn("distance", F.round("distance", 6) + 0.0)


_BOW = """tok AS (SELECT id AS key, unnest(list_filter(regexp_split_to_array(lower(content), '\\s+'), lambda w: w <> '')) AS w FROM (SELECT DISTINCT id, content FROM chunks)),
cnt AS (SELECT key, CAST(('0x' || substr(md5(w), 7, 2) || substr(md5(w), 5, 2) || substr(md5(w), 3, 2) || substr(md5(w), 1, 2)) AS BIGINT) % 64 AS bucket, count(*) AS n FROM tok GROUP BY ALL),
nrm AS (SELECT key, sqrt(sum(n * n)::DOUBLE) AS norm FROM cnt GROUP BY key), bow AS (SELECT key, bucket, n / norm AS value FROM cnt JOIN nrm USING (key))"""


@query(f"WITH {_BOW} SELECT key, bucket, round(value, 8) AS value FROM bow")
def bow_embedding(spark, root):
    c = table(spark, root, "chunks").select("id", "content").distinct()
    return vectors.bag_of_words(c, "id", "content").withColumn("value", F.round("value", 8))


_BOW_SEARCH = (
    f"""WITH {_BOW}, qtok AS (SELECT query_id, repo, unnest(list_filter(regexp_split_to_array(lower(query_text), '\\s+'), lambda w: w <> '')) AS w FROM queries),
qc AS (SELECT query_id, repo, CAST(('0x' || substr(md5(w), 7, 2) || substr(md5(w), 5, 2) || substr(md5(w), 3, 2) || substr(md5(w), 1, 2)) AS BIGINT) % 64 AS bucket, count(*) AS n FROM qtok GROUP BY ALL),
qn AS (SELECT query_id, sqrt(sum(n * n)::DOUBLE) AS norm FROM qc GROUP BY query_id),
own AS (SELECT DISTINCT id AS key, repo FROM chunks),
s AS (SELECT query_id, key, sum(n / norm * value) AS score FROM qc JOIN qn USING (query_id) JOIN own USING (repo) JOIN bow USING (key, bucket) GROUP BY ALL),
r AS (SELECT query_id, key, round(score, 8) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, key) AS rank FROM s)
SELECT * FROM r WHERE rank <= """
)


@query(_BOW_SEARCH + "10")
def bow_cosine_search(spark, root):
    """The ten chunks of a query's repository nearest to it by bag-of-words cosine, of those that share a bucket with it."""
    return _bow_search(spark, root, 10)


def _bow_search(spark: SparkSession, root: str, k: int) -> DataFrame:
    """A chunk is embedded where it is read; ids delivered twice come twice among the best and are made one at the end."""
    c = once(table(spark, root, "chunks").select(F.col("repo").alias("grp"), F.col("id").alias("key"), F.col("content").alias("x")), ["grp", "key"], DataFrame.distinct)
    q = table(spark, root, "queries").select("query_id", F.col("repo").alias("grp"), F.col("query_text").alias("x"))
    return vectors.search(c, q, k, positive=True, embed=vectors.embedder()).withColumn("score", F.round("score", 8))


_VEC_ALL = """WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0),
d AS (SELECT query_id, vec_id AS key, {0} AS score FROM embeddings, q),
r AS (SELECT query_id, key, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10){1}, key) AS rank FROM d)
SELECT query_id, key, score, rank FROM r WHERE rank <= {2}"""


def _knn(spark: SparkSession, root: str, k: int, metric: str) -> DataFrame:
    e = table(spark, root, "embeddings").select(F.lit(0).alias("grp"), F.col("vec_id").alias("key"), F.col("embedding").alias("x"))
    q = e.where(F.col("key") % 20 == 0).withColumnRenamed("key", "query_id")
    return vectors.search(e, q, k, metric).withColumn("score", F.round("score", 6) + 0.0)


@query(_VEC_ALL.format("list_distance(embedding::DOUBLE[], v)", "", 90))
def knn_l2_all(spark, root):
    """The 90 nearest of all vectors for every vector whose id is divisible by 20."""
    return _knn(spark, root, 90, "l2")


@query(_VEC_ALL.format("list_cosine_similarity(embedding::DOUBLE[], v)", " DESC", 30))
def knn_cosine_all(spark, root):
    return _knn(spark, root, 30, "cosine")


# Query classification and symbols.

_SYM = """regexp_replace(w, '^[()\\[\\]{}:;,.]+|[()\\[\\]{}:;,.]+$', '', 'g')"""


@query(
    f"""WITH t AS (SELECT query_id, unnest(list_filter(regexp_split_to_array(coalesce(query_text, ''), '\\s+'), lambda w: w <> '')) AS w FROM queries),
s AS (SELECT query_id, {_SYM} AS x FROM t)
SELECT q.query_id, round(coalesce(sum(CASE WHEN lower(x) IN ('how','what','where','why','when','which','does','is') THEN -0.1e0 ELSE 0e0 END
 + CASE WHEN regexp_full_match(x, '[A-Z][a-z]+([A-Z][a-z]+)+') THEN 0.3e0 ELSE 0e0 END + CASE WHEN regexp_full_match(x, '[a-z]+(_[a-z]+)+') THEN 0.2e0 ELSE 0e0 END
 + CASE WHEN regexp_full_match(x, '\\w+\\.\\w+') THEN 0.2e0 ELSE 0e0 END + CASE WHEN regexp_full_match(x, '[a-z]+([A-Z][a-z]+)+') THEN 0.1e0 ELSE 0e0 END), 0e0), 6) AS weight
FROM queries q LEFT JOIN s ON q.query_id = s.query_id GROUP BY q.query_id"""
)
def symbol_weights(spark, root):
    return table(spark, root, "queries").select("query_id", F.round(symbol_weight(F.col("query_text")), 6).alias("weight"))


_CAND = """t AS (SELECT query_id, repo, list_filter(regexp_split_to_array(coalesce(query_text, ''), '\\s+'), lambda w: w <> '') AS a FROM queries),
u AS (SELECT query_id, repo, unnest(range(0, len(a))) AS i, regexp_replace(unnest(a), '^[()\\[\\]{}:;,.''"?]+|[()\\[\\]{}:;,.''"?]+$', '', 'g') AS name FROM t),
cand AS (SELECT query_id, repo, name, row_number() OVER (PARTITION BY query_id ORDER BY i) AS pos FROM u
 WHERE regexp_full_match(name, '[A-Z][a-z]+([A-Z][a-z]+)+|[a-z]+(_[a-z]+)+|[a-z]+([A-Z][a-z]+)+|\\w+\\.\\w+'))"""


@query(f"WITH {_CAND} SELECT query_id, name, pos FROM cand")
def symbol_candidate_words(spark, root):
    q = table(spark, root, "queries").select("query_id", F.posexplode(symbol_candidates(F.col("query_text"))).alias("pos", "name"))
    return q.select("query_id", "name", (F.col("pos") + 1).cast("long").alias("pos"))


@query(
    f"""WITH {_CAND}, c AS (SELECT DISTINCT query_id, repo, name FROM cand),
h AS (SELECT c.query_id, c.name, k.id AS chunk_id, row_number() OVER (PARTITION BY c.query_id, c.name ORDER BY k.id) AS place FROM c
 JOIN (SELECT DISTINCT repo, id, symbol_name FROM chunks) k ON k.repo = c.repo AND lower(k.symbol_name) = lower(c.name))
SELECT query_id, name, chunk_id, place FROM h WHERE place <= 5"""
)
def symbol_exact_nocase(spark, root):
    """For each symbol-like word of a query at most five chunks of that name, letter case ignored."""
    q = table(spark, root, "queries").select("query_id", "repo", F.explode(symbol_candidates(F.col("query_text"))).alias("name")).distinct()
    c = table(spark, root, "chunks").select("repo", F.col("id").alias("chunk_id"), F.lower("symbol_name").alias("lc"), "symbol_name").distinct()
    j = q.withColumn("lc", F.lower("name")).join(c, ["repo", "lc"])
    w = Window.partitionBy("query_id", "name").orderBy("chunk_id")
    return j.withColumn("place", F.row_number().over(w).cast("long")).where("place <= 5").select("query_id", "name", "chunk_id", "place")


# Fusion over the stored lists.


def _lists(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    s = table(spark, root, "search_rows").withColumn("r", F.lower(F.trim("match_reason")))
    kind = F.when(F.col("r").contains("reranked"), "rerank").when(F.col("r").startswith("bm25"), "bm25").when(F.col("r").startswith("vector"), "vector").when(F.col("r") == "symbol_exact", "symbol")
    s = s.withColumn("l", kind)
    one = lambda k, m: s.where(F.col("l") == k).groupBy("query_id", "chunk_id").agg(m.alias("m"), F.max("search_quality").alias("search_quality"))
    fts = one("bm25", F.max("score")).where("m is not null")
    vec = one("vector", F.min("distance")).where("m is not null")
    sym = one("symbol", F.max("score"))
    return (
        fusion.list_ranks(fts.withColumn("score", F.col("m")), ["query_id"], "chunk_id", F.col("m").desc()),
        fusion.list_ranks(vec, ["query_id"], "chunk_id", F.col("m").asc()),
        sym.withColumn("rank", F.lit(1)),
    )


_LISTS = """s AS (SELECT *, CASE WHEN lower(trim(match_reason)) LIKE '%reranked%' THEN 'rerank' WHEN lower(trim(match_reason)) LIKE 'bm25%' THEN 'bm25' WHEN lower(trim(match_reason)) LIKE 'vector%' THEN 'vector'
 WHEN lower(trim(match_reason)) = 'symbol_exact' THEN 'symbol' END AS l FROM search_rows),
fts AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY m DESC, chunk_id) AS rank FROM (SELECT query_id, chunk_id, max(score) AS m, max(search_quality) AS q FROM s WHERE l = 'bm25' GROUP BY ALL) WHERE m IS NOT NULL),
vec AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY m, chunk_id) AS rank FROM (SELECT query_id, chunk_id, min(distance) AS m, max(search_quality) AS q FROM s WHERE l = 'vector' GROUP BY ALL) WHERE m IS NOT NULL),
sym AS (SELECT query_id, chunk_id, max(score) AS m, max(search_quality) AS q, 1 AS rank FROM s WHERE l = 'symbol' GROUP BY query_id, chunk_id),
parts AS (SELECT query_id, chunk_id, q, 'bm25' AS src, 1e0 / (15 + rank) AS part FROM fts UNION ALL SELECT query_id, chunk_id, q, 'vector', 1e0 / (15 + rank) FROM vec
 UNION ALL SELECT query_id, chunk_id, q, 'symbol', 1e0 / 16 FROM sym)"""
_FUSE = """SELECT query_id, chunk_id, sum(part){0} AS score, concat_ws('+', max(src) FILTER (WHERE src = 'bm25'), max(src) FILTER (WHERE src = 'vector'), max(src) FILTER (WHERE src = 'symbol')) AS reason FROM parts {1} GROUP BY query_id, chunk_id"""
_QF = " * CASE max(q) WHEN 'ast' THEN 1e0 WHEN 'regex' THEN 0.85e0 WHEN 'text_fallback' THEN 0.7e0 ELSE 1e0 END"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 8))


@query(f"WITH {_LISTS}, f AS ({_FUSE.format('', "WHERE src <> 'symbol'")}) SELECT query_id, chunk_id, round(score, 8) AS score, reason FROM f")
def rrf_hybrid(spark, root):
    return _rounded(fusion.reciprocal(*_lists(spark, root), weighted=False, bonus=False))


@query(f"WITH {_LISTS}, f AS ({_FUSE.format(_QF, '')}) SELECT query_id, chunk_id, round(score, 8) AS score, reason FROM f")
def rrf_quality_weighted(spark, root):
    return _rounded(fusion.reciprocal(*_lists(spark, root)))


@query(f"WITH {_LISTS}, f AS ({_FUSE.format('', '')}) SELECT query_id, chunk_id, round(score, 8) AS score, reason FROM f")
def symbol_bonus_fusion(spark, root):
    return _rounded(fusion.reciprocal(*_lists(spark, root), weighted=False))


_FTS_ONLY = f"""{_LISTS}, a AS (SELECT query_id, chunk_id, m AS score, q, 1 AS b, 0 AS y FROM fts UNION ALL SELECT query_id, chunk_id, 100e0, q, 0, 1 FROM sym),
f AS (SELECT query_id, chunk_id, max(score) AS sc, max(q) AS q, max(b) AS b, max(y) AS y, max(score) FILTER (WHERE b = 1) AS bm FROM a GROUP BY ALL)"""


@query(
    f"""WITH {_FTS_ONLY} SELECT query_id, chunk_id, round(sc * CASE q WHEN 'ast' THEN 1e0 WHEN 'regex' THEN 0.85e0 WHEN 'text_fallback' THEN 0.7e0 ELSE 1e0 END, 8) AS score,
CASE WHEN b = 1 AND y = 1 AND bm < 100 THEN 'bm25+symbol' WHEN b = 1 THEN 'bm25' ELSE 'symbol_exact' END AS reason FROM f"""
)
def fts_only_mode(spark, root):
    fts, _, sym = _lists(spark, root)
    return _rounded(fusion.full_text_only(fts, sym))


def _fused_top(spark: SparkSession, root: str) -> DataFrame:
    q = table(spark, root, "queries").select("query_id", "top_k")
    fused = fusion.reciprocal(*_lists(spark, root)).join(q, "query_id")
    return fusion.top(fused, F.col("top_k")).drop("top_k")


_TOP = f"""{_LISTS}, f AS ({_FUSE.format(_QF, '')}), ranked AS (SELECT f.*, row_number() OVER (PARTITION BY f.query_id ORDER BY round(score, 10) DESC, chunk_id) AS position, top_k FROM f JOIN queries USING (query_id)),
top AS (SELECT * FROM ranked WHERE position <= top_k)"""


@query(f"WITH {_TOP} SELECT query_id, chunk_id, round(score, 4) AS score, reason, position FROM top")
def hybrid_top_k(spark, root):
    return _fused_top(spark, root).withColumn("score", F.round("score", 4))


@query(f"WITH {_TOP} SELECT query_id, chunk_id, round(1e0 - 0.01e0 * (position - 1), 6) AS score, CASE WHEN reason = '' THEN 'reranked' ELSE reason || '+reranked' END AS reason, position FROM top")
def rerank_dummy(spark, root):
    return fusion.rerank_by_place(_fused_top(spark, root)).withColumn("score", F.round("score", 6))


@query(
    f"""WITH {_TOP}, j AS (SELECT repo, t.query_id, chunk_id, score FROM top t JOIN queries USING (query_id)), b AS (SELECT repo, max(score) AS best FROM j GROUP BY repo)
SELECT repo, query_id, chunk_id, round(CASE WHEN best > 0 THEN score / best ELSE score END, 8) AS score FROM j JOIN b USING (repo)"""
)
def multi_repo_normalised(spark, root):
    """Results of all repositories on one scale: divided by the best score of their repository."""
    q = table(spark, root, "queries").select("query_id", "repo")
    return _rounded(fusion.normalised(_fused_top(spark, root).join(q, "query_id"), "repo")).select("repo", "query_id", "chunk_id", "score")


@query(
    f"""WITH {_LISTS}, f AS ({_FUSE.format(_QF, '')}), ranked AS (SELECT f.*, row_number() OVER (PARTITION BY f.query_id ORDER BY round(score, 10) DESC, chunk_id) AS place, top_k FROM f JOIN queries USING (query_id)),
again AS (SELECT query_id, chunk_id, round(1e0 - 0.01e0 * (place - 1), 6) AS score, reason || '+reranked' AS reason, top_k FROM ranked WHERE place <= 3 * top_k),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS position FROM again) SELECT query_id, chunk_id, score, reason, position FROM p WHERE position <= top_k"""
)
def rerank_window(spark, root):
    """The three times top_k best are reranked, of these top_k stay."""
    q = table(spark, root, "queries").select("query_id", "top_k")
    wide = fusion.top(fusion.reciprocal(*_lists(spark, root)).join(q, "query_id"), 3 * F.col("top_k"))
    again = fusion.rerank_by_place(wide).drop("position").withColumn("score", F.round("score", 6))
    return fusion.top(again, F.col("top_k")).drop("top_k")


@query(
    f"""WITH {_TOP}, j AS (SELECT repo, t.query_id, chunk_id, score FROM top t JOIN queries USING (query_id)), b AS (SELECT repo, max(score) AS best FROM j GROUP BY repo),
n AS (SELECT repo, query_id, chunk_id, round(CASE WHEN best > 0 THEN score / best ELSE score END, 8) AS score FROM j JOIN b USING (repo))
SELECT * FROM n ORDER BY score DESC, repo, query_id, chunk_id LIMIT 100"""
)
def multi_repo_top(spark, root):
    """The hundred best results over all repositories, on one scale."""
    return multi_repo_normalised(spark, root).orderBy(F.col("score").desc(), "repo", "query_id", "chunk_id").limit(100)


@query(f"WITH {_TOP}, p AS (SELECT DISTINCT chunk_id, file_path FROM search_rows) SELECT query_id, file_path, min(position) AS first_position FROM top JOIN p USING (chunk_id) GROUP BY ALL")
def distinct_files(spark, root):
    p = table(spark, root, "search_rows").select("chunk_id", "file_path").distinct()
    return _fused_top(spark, root).join(p, "chunk_id").groupBy("query_id", "file_path").agg(F.min("position").alias("first_position"))


@query("SELECT id, branches FROM (SELECT DISTINCT id, branches FROM chunks) WHERE coalesce(branches, '') = '' OR list_contains(string_split(branches, ','), 'main')")
def branch_filter(spark, root):
    return index.on_branch(table(spark, root, "chunks").select("id", "branches").distinct(), "branches", "main")


_GATED = """w AS (SELECT q.query_id, coalesce(sum(CASE WHEN lower(x) IN ('how','what','where','why','when','which','does','is') THEN -0.1e0 ELSE 0e0 END
 + CASE WHEN regexp_full_match(x, '[A-Z][a-z]+([A-Z][a-z]+)+') THEN 0.3e0 ELSE 0e0 END + CASE WHEN regexp_full_match(x, '[a-z]+(_[a-z]+)+') THEN 0.2e0 ELSE 0e0 END
 + CASE WHEN regexp_full_match(x, '\\w+\\.\\w+') THEN 0.2e0 ELSE 0e0 END + CASE WHEN regexp_full_match(x, '[a-z]+([A-Z][a-z]+)+') THEN 0.1e0 ELSE 0e0 END), 0e0) AS weight
 FROM queries q LEFT JOIN (SELECT query_id, {0} AS x FROM (SELECT query_id, unnest(list_filter(regexp_split_to_array(coalesce(query_text, ''), '\\s+'), lambda w: w <> '')) AS w FROM queries)) s ON q.query_id = s.query_id GROUP BY q.query_id)"""


@query(
    f"""WITH ft AS ({_bm25_sql(_CHUNK_ROWS, "SELECT query_id, repo AS grp, query_text FROM queries", 30, ["content", "file_path", "symbol_name"])}), ve AS ({_BOW_SEARCH}90), {_CAND}, {_GATED.format(_SYM)},
c AS (SELECT DISTINCT cand.query_id, repo, lower(name) AS lc FROM cand JOIN w ON cand.query_id = w.query_id WHERE weight >= 0.3e0 - 1e-9),
sy AS (SELECT query_id, chunk_id FROM (SELECT c.query_id, k.id AS chunk_id, row_number() OVER (PARTITION BY c.query_id, c.lc ORDER BY k.id) AS place FROM c JOIN (SELECT DISTINCT repo, id, symbol_name FROM chunks) k ON k.repo = c.repo AND lower(k.symbol_name) = c.lc) WHERE place <= 5),
parts AS (SELECT query_id, key AS chunk_id, 'bm25' AS src, 1e0 / (15 + rank) AS part FROM ft UNION ALL SELECT query_id, key, 'vector', 1e0 / (15 + rank) FROM ve UNION ALL SELECT query_id, chunk_id, 'symbol', 1e0 / 16 FROM sy),
ql AS (SELECT id AS chunk_id, max(search_quality) AS q FROM chunks GROUP BY id),
f AS (SELECT query_id, chunk_id, sum(part){_QF} AS score, concat_ws('+', max(src) FILTER (WHERE src = 'bm25'), max(src) FILTER (WHERE src = 'vector'), max(src) FILTER (WHERE src = 'symbol')) AS reason FROM parts JOIN ql USING (chunk_id) GROUP BY query_id, chunk_id),
p AS (SELECT f.*, row_number() OVER (PARTITION BY f.query_id ORDER BY round(score, 10) DESC, chunk_id) AS position, top_k FROM f JOIN queries USING (query_id))
SELECT query_id, chunk_id, round(score, 8) AS score, reason, position FROM p WHERE position <= top_k"""
)
def fused_search(spark, root):
    """Every row of `queries` against the chunks of its repository: full text, bag-of-words vectors and, where it looks like one, symbol names, fused to its top_k."""
    q = table(spark, root, "queries").select("query_id", "repo", "query_text", "top_k")
    quality = table(spark, root, "chunks").groupBy(F.col("id").alias("chunk_id")).agg(F.max("search_quality").alias("search_quality"))
    full = _batch_search(spark, root, 30).select("query_id", F.col("key").alias("chunk_id"), "rank")
    near = _bow_search(spark, root, 90).select("query_id", F.col("key").alias("chunk_id"), "rank")
    gated = q.where(symbol_weight(F.col("query_text")) >= 0.3 - 1e-9).select("query_id", "repo", F.explode(symbol_candidates(F.col("query_text"))).alias("name")).select("query_id", "repo", F.lower("name").alias("lc")).distinct()
    named = table(spark, root, "chunks").select("repo", F.col("id").alias("chunk_id"), F.lower("symbol_name").alias("lc"), "symbol_name").distinct()
    symbol = fusion.list_ranks(gated.join(named, ["repo", "lc"]), ["query_id", "lc"], "chunk_id", F.lit(0)).where("rank <= 5")
    lists = [x.select("query_id", "chunk_id", "rank").join(quality, "chunk_id") for x in (full, near, symbol)]
    fused = fusion.reciprocal(*lists).join(q.select("query_id", "top_k"), "query_id")
    return _rounded(fusion.top(fused, F.col("top_k")).drop("top_k"))


# The graph.

_LOOKUP = """defs AS (SELECT DISTINCT repo, symbol_name AS name, chunk_id FROM symbol_lookup WHERE removed_at IS NULL),
known AS (SELECT id AS chunk_id, max(search_quality) AS q FROM chunks GROUP BY id),
found AS (SELECT n.repo, n.name, d.chunk_id, row_number() OVER (PARTITION BY n.repo, n.name ORDER BY CASE q WHEN 'ast' THEN 0 WHEN 'regex' THEN 1 WHEN 'text_fallback' THEN 2 ELSE 3 END, d.chunk_id) AS place
 FROM names n JOIN defs d ON n.repo = d.repo AND n.name = d.name JOIN known k ON k.chunk_id = d.chunk_id)"""


@query(f"WITH names AS (SELECT DISTINCT repo, target_symbol AS name FROM refs WHERE target_symbol IS NOT NULL), {_LOOKUP} SELECT repo, name, chunk_id, place FROM found WHERE place <= 25")
def lookup_symbols_capped(spark, root):
    names = table(spark, root, "refs").select("repo", F.col("target_symbol").alias("name")).where("name is not null")
    return graph.lookup_symbols(names, table(spark, root, "symbol_lookup"), table(spark, root, "chunks"))


@query(
    f"""WITH {_LISTS}, f AS ({_FUSE.format(_QF, '')}), pos AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, chunk_id) AS position FROM f),
edges AS (SELECT DISTINCT repo, source_chunk_id AS chunk_id, target_symbol AS name FROM refs WHERE target_symbol IS NOT NULL),
wanted AS (SELECT query_id, position, repo, name FROM pos JOIN edges USING (chunk_id) WHERE position <= 5), names AS (SELECT DISTINCT repo, name FROM wanted), {_LOOKUP},
hits AS (SELECT query_id, chunk_id, min(struct_pack(position := position, name := name, place := place)) AS o FROM wanted JOIN (SELECT * FROM found WHERE place <= 25) USING (repo, name) GROUP BY ALL),
fresh AS (SELECT h.* FROM hits h ANTI JOIN f USING (query_id, chunk_id)), slots AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY o, chunk_id) AS slot FROM fresh)
SELECT * FROM slots WHERE slot <= 10"""
)
def graph_expand_onehop(spark, root):
    fused = fusion.reciprocal(*_lists(spark, root))
    seeds = fusion.top(fused, F.lit(graph.SEEDS))
    return graph.expand(seeds, fused.select("query_id", "chunk_id"), table(spark, root, "refs"), table(spark, root, "symbol_lookup"), table(spark, root, "chunks"))


_ON_BRANCH = """br AS (SELECT id AS chunk_id, max(coalesce(branches, '')) AS branches FROM chunks GROUP BY id),
f AS (SELECT g.* FROM g JOIN br USING (chunk_id) JOIN queries USING (query_id) WHERE coalesce(branch, '') = '' OR branches = '' OR list_contains(string_split(branches, ','), branch))"""


@query(
    f"""WITH {_LISTS}, g AS ({_FUSE.format(_QF, '')}), {_ON_BRANCH}, pos AS (SELECT f.*, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, chunk_id) AS position FROM f),
base AS (SELECT query_id, chunk_id, score, reason, position FROM pos JOIN queries USING (query_id) WHERE position <= 2 * top_k),
edges AS (SELECT DISTINCT repo, source_chunk_id AS chunk_id, target_symbol AS name FROM refs WHERE target_symbol IS NOT NULL),
wanted AS (SELECT query_id, position, repo, name FROM pos JOIN edges USING (chunk_id) WHERE position <= 5), names AS (SELECT DISTINCT repo, name FROM wanted), {_LOOKUP},
hits AS (SELECT query_id, chunk_id, min(struct_pack(position := position, name := name, place := place)) AS o FROM wanted JOIN (SELECT * FROM found WHERE place <= 25) USING (repo, name) GROUP BY ALL),
fresh AS (SELECT h.* FROM hits h ANTI JOIN f USING (query_id, chunk_id)), slots AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY o, chunk_id) AS slot FROM fresh),
ends AS (SELECT query_id, max(position) AS last FROM base GROUP BY query_id),
more AS (SELECT query_id, chunk_id, 0e0 AS score, 'graph_expansion' AS reason, last + row_number() OVER (PARTITION BY query_id ORDER BY slot) AS position FROM slots JOIN ends USING (query_id) WHERE slot <= 10)
SELECT query_id, chunk_id, round(score, 8) AS score, reason, position FROM base UNION ALL
SELECT query_id, chunk_id, score, reason, position FROM more JOIN queries USING (query_id) WHERE position <= 2 * top_k"""
)
def branch_results_filled(spark, root):
    """Twice top_k results on a query's branch; what the branch leaves empty is filled by the chunks the first five refer to."""
    q = table(spark, root, "queries").select("query_id", "top_k", F.coalesce("branch", F.lit("")).alias("branch"))
    br = table(spark, root, "chunks").groupBy(F.col("id").alias("chunk_id")).agg(F.max(F.coalesce("branches", F.lit(""))).alias("branches"))
    j = fusion.reciprocal(*_lists(spark, root)).join(q, "query_id").join(br, "chunk_id")
    f = j.where((F.col("branch") == "") | (F.col("branches") == "") | F.array_contains(F.split("branches", ","), F.col("branch"))).select("query_id", "chunk_id", "score", "reason", "top_k")
    placed = fusion.top(f, F.greatest(2 * F.col("top_k"), F.lit(graph.SEEDS)))
    seeds = placed.where(F.col("position") <= graph.SEEDS)
    more = graph.expand(seeds, f.select("query_id", "chunk_id"), table(spark, root, "refs"), table(spark, root, "symbol_lookup"), table(spark, root, "chunks"))
    base = placed.where(F.col("position") <= 2 * F.col("top_k"))
    out = fusion.fill(base.drop("top_k"), more, F.lit(1_000_000)).join(q.select("query_id", "top_k"), "query_id")
    return _rounded(out.where(F.col("position") <= 2 * F.col("top_k")).drop("top_k"))


@query(
    """WITH n AS (SELECT DISTINCT repo, target_symbol AS name FROM refs WHERE target_symbol IS NOT NULL), k AS (SELECT DISTINCT repo, id, symbol_name FROM chunks WHERE symbol_name IS NOT NULL),
h AS (SELECT n.repo, n.name, k.id AS chunk_id, row_number() OVER (PARTITION BY n.repo, n.name ORDER BY k.id) AS place FROM n JOIN k ON n.repo = k.repo AND lower(n.name) = lower(k.symbol_name)) SELECT * FROM h WHERE place <= 5"""
)
def symbol_exact_of_targets(spark, root):
    """For each name that references use at most five chunks of that name in the repository, letter case ignored."""
    n = table(spark, root, "refs").where("target_symbol is not null").select("repo", F.col("target_symbol").alias("name"), F.lower("target_symbol").alias("lc")).distinct()
    k = table(spark, root, "chunks").where("symbol_name is not null").select("repo", F.col("id").alias("chunk_id"), F.lower("symbol_name").alias("lc")).distinct()
    w = Window.partitionBy("repo", "name").orderBy("chunk_id")
    return n.join(k, ["repo", "lc"]).withColumn("place", F.row_number().over(w).cast("long")).where("place <= 5").select("repo", "name", "chunk_id", "place")


# Identity, chunking, references.


@query("SELECT DISTINCT id, substr(sha256(length(file_path) || ':' || file_path || '|' || length(symbol_name) || ':' || symbol_name || '|' || sha256(content)), 1, 32) AS made FROM chunks WHERE content IS NOT NULL")
def chunk_id_hash(spark, root):
    c = table(spark, root, "chunks").where("content is not null")
    return c.select("id", chunk_id(F.col("file_path"), F.col("symbol_name"), F.col("content")).alias("made")).distinct()


_NL = "regexp_split_to_array(text, '\\n\\s*\\n')"


@query(
    f"""WITH p AS (SELECT doc_id, list_filter(list_transform({_NL}, lambda x: regexp_replace(x, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g')), lambda x: x <> '') AS a FROM documents WHERE text IS NOT NULL)
SELECT doc_id, unnest(range(1, len(a) + 1)) AS piece, unnest(a) AS content FROM p"""
)
def chunk_blank_line(spark, root):
    d = table(spark, root, "documents").where("text is not null")
    pieces = F.filter(F.transform(F.split("text", r"\n\s*\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    return d.select("doc_id", F.posexplode(pieces).alias("p", "content")).select("doc_id", (F.col("p") + 1).cast("long").alias("piece"), "content")


@query(
    """WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \\t\\n\\x0B\\f\\r]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g')), lambda x: x <> '') AS a FROM documents WHERE text IS NOT NULL)
SELECT doc_id, unnest(range(1, len(a) + 1)) AS sentence, length(unnest(a)) AS chars FROM p"""
)
def chunk_sentences(spark, root):
    d = table(spark, root, "documents").where("text is not null")
    s = F.filter(F.transform(F.split("text", r"(?<=[.!?])\s+"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    return d.select("doc_id", F.posexplode(s).alias("p", "x")).select("doc_id", (F.col("p") + 1).cast("long").alias("sentence"), F.length("x").cast("long").alias("chars"))


@query("SELECT DISTINCT id, 1 + length(substr(content, 1, position('{' IN content) - 1)) - length(replace(substr(content, 1, position('{' IN content) - 1), chr(10), '')) AS line FROM chunks WHERE position('{' IN content) > 0")
def line_of_offset(spark, root):
    c = table(spark, root, "chunks").where(F.instr("content", "{") > 0)
    head = F.col("content").substr(F.lit(1), F.instr("content", "{") - 1)
    return c.select("id", (F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("line")).distinct()


_WHOLE = "SELECT DISTINCT repo, file_path, id, start_line, end_line, symbol_name FROM chunks WHERE coalesce(trim(parent_chunk_id), '') = ''"


@query(
    f"""WITH w AS ({_WHOLE}), l AS (SELECT repo, file_path, CAST(unnest(range(1, max(end_line) + 1)) AS INTEGER) AS line FROM w GROUP BY repo, file_path),
a AS (SELECT l.repo, l.file_path, l.line, max(struct_pack(s := start_line, id := id, e := end_line)) FILTER (WHERE start_line <= line) AS hit, min(struct_pack(s := start_line, id := id)) AS head FROM l JOIN w USING (repo, file_path) GROUP BY ALL)
SELECT repo, file_path, line, CASE WHEN line <= hit.e THEN hit.id ELSE head.id END AS chunk_id FROM a"""
)
def ref_line_to_chunk(spark, root):
    """Every line of a file to the chunk that holds it, the last to start at or before it; lines in none fall to the file's first chunk.

    Lines and starts of chunks lie in one order, so a file costs one sort and no line meets every chunk."""
    w = _whole(spark, root)
    span = F.struct(F.col("start_line").alias("s"), "id", F.col("end_line").alias("e"))
    starts = w.groupBy("repo", "file_path", F.col("start_line").alias("line")).agg(F.max(span).alias("at"))
    ends = w.groupBy("repo", "file_path").agg(F.max("end_line").alias("m"), F.min(F.struct("start_line", "id"))["id"].alias("first"))
    lines = ends.select("repo", "file_path", "first", F.explode(F.sequence(F.lit(1), F.col("m"))).alias("line")).join(starts, ["repo", "file_path", "line"], "left")
    at = F.last("at", ignorenulls=True).over(Window.partitionBy("repo", "file_path").orderBy("line"))
    return lines.withColumn("at", at).select("repo", "file_path", "line", F.when(F.col("line") <= F.col("at.e"), F.col("at.id")).otherwise(F.col("first")).alias("chunk_id"))


def _whole(spark: SparkSession, root: str) -> DataFrame:
    w = table(spark, root, "chunks").where(F.coalesce(F.trim("parent_chunk_id"), F.lit("")) == "")
    return w.select("repo", "file_path", "id", "start_line", "end_line", "symbol_name").distinct()


@query(
    f"""WITH w AS ({_WHOLE}), s AS (SELECT DISTINCT repo, file_path, id, start_line AS line FROM chunks WHERE coalesce(trim(parent_chunk_id), '') <> '')
SELECT s.id, count(w.id) > 0 AS inside, min(w.id) AS holder FROM s LEFT JOIN w ON s.repo = w.repo AND s.file_path = w.file_path AND s.line BETWEEN w.start_line AND w.end_line GROUP BY s.id"""
)
def span_membership(spark, root):
    """For each sub-chunk whether its first line lies in a whole chunk of its file, and in which: the file's spans travel as one array."""
    spans = _whole(spark, root).groupBy("repo", "file_path").agg(F.collect_list(F.struct("id", "start_line", "end_line")).alias("spans"))
    s = table(spark, root, "chunks").where(F.coalesce(F.trim("parent_chunk_id"), F.lit("")) != "").select("repo", "file_path", "id", F.col("start_line").alias("line")).distinct()
    hits = F.filter("spans", lambda x: F.col("line").between(x["start_line"], x["end_line"]))
    j = s.join(spans, ["repo", "file_path"], "left").select("id", F.coalesce(F.transform(hits, lambda x: x["id"]), F.array()).alias("ids"))
    return j.groupBy("id").agg(F.max(F.size("ids") > 0).alias("inside"), F.min(F.array_min("ids")).alias("holder"))


@query(
    """WITH s AS (SELECT DISTINCT id, parent_chunk_id, start_line, sub_chunk_index FROM chunks WHERE coalesce(trim(parent_chunk_id), '') <> '')
SELECT id, lower(trim(parent_chunk_id)) AS parent, row_number() OVER (PARTITION BY lower(trim(parent_chunk_id)) ORDER BY start_line, id) - 1 AS place FROM s"""
)
def sub_chunk_index(spark, root):
    c = table(spark, root, "chunks").where(F.coalesce(F.trim("parent_chunk_id"), F.lit("")) != "")
    s = c.select("id", F.lower(F.trim("parent_chunk_id")).alias("parent"), "start_line").distinct()
    return s.select("id", "parent", (F.row_number().over(Window.partitionBy("parent").orderBy("start_line", "id")) - 1).cast("long").alias("place"))


@query(f"WITH w AS ({_WHOLE}) SELECT repo, file_path, id, start_line, lead(start_line) OVER (PARTITION BY repo, file_path ORDER BY start_line, id) - 1 AS last_line FROM w")
def section_spans(spark, root):
    c = table(spark, root, "chunks")
    w = c.where(F.coalesce(F.trim("parent_chunk_id"), F.lit("")) == "").select("repo", "file_path", "id", "start_line", "end_line", "symbol_name").distinct()
    return w.select("repo", "file_path", "id", "start_line", (F.lead("start_line").over(Window.partitionBy("repo", "file_path").orderBy("start_line", "id")) - 1).alias("last_line"))


@query(
    """WITH c AS (SELECT DISTINCT id, content FROM chunks WHERE regexp_matches(file_path, '(?i)\\.py$')),
m AS (SELECT id, unnest(regexp_extract_all(content, '(?m)^from[ \\t]+([\\w.]+)[ \\t]+import[ \\t]+[\\w, \\t]+', 1)) AS module, unnest(regexp_extract_all(content, '(?m)^from[ \\t]+[\\w.]+[ \\t]+import[ \\t]+([\\w, \\t]+)', 1)) AS names FROM c)
SELECT id, module || '.' || trim(split_part(trim(n), ' ', 1)) AS target FROM (SELECT id, module, unnest(string_split(names, ',')) AS n FROM m) WHERE trim(n) <> ''"""
)
def python_import_refs(spark, root):
    """`from m import a as b, c` in Python chunks as references m.a and m.c."""
    c = table(spark, root, "chunks").where(F.col("file_path").rlike(r"(?i)\.py$")).select("id", "content").distinct()
    pat = r"(?m)^from[ \t]+([\w.]+)[ \t]+import[ \t]+([\w, \t]+)"
    z = F.arrays_zip(F.regexp_extract_all("content", F.lit(pat), F.lit(1)).alias("module"), F.regexp_extract_all("content", F.lit(pat), F.lit(2)).alias("names"))
    m = c.select("id", F.explode(z).alias("x")).select("id", F.col("x.module").alias("module"), F.explode(F.split("x.names", ",")).alias("n")).where(F.trim("n") != "")
    return m.select("id", F.concat("module", F.lit("."), F.trim(F.element_at(F.split(F.trim("n"), " "), 1))).alias("target"))


@query(
    """WITH c AS (SELECT DISTINCT id, content FROM chunks WHERE regexp_matches(file_path, '(?i)\\.(ts|tsx|js)$')),
m AS (SELECT id, unnest(regexp_extract_all(content, '(?m)^import[ \\t]*\\{([^}]*)\\}[ \\t]*from', 1)) AS names FROM c)
SELECT id, split_part(trim(n), ' ', 1) AS target FROM (SELECT id, unnest(string_split(names, ',')) AS n FROM m) WHERE trim(n) <> ''"""
)
def ts_import_refs(spark, root):
    c = table(spark, root, "chunks").where(F.col("file_path").rlike(r"(?i)\.(ts|tsx|js)$")).select("id", "content").distinct()
    names = F.explode(F.regexp_extract_all("content", F.lit(r"(?m)^import[ \t]*\{([^}]*)\}[ \t]*from"), F.lit(1)))
    m = c.select("id", names.alias("names")).select("id", F.explode(F.split("names", ",")).alias("n")).where(F.trim("n") != "")
    return m.select("id", F.element_at(F.split(F.trim("n"), " "), 1).alias("target"))


@query(
    """WITH c AS (SELECT DISTINCT id, content FROM chunks WHERE regexp_matches(file_path, '(?i)\\.php$'))
SELECT id, unnest(regexp_extract_all(content, '(?m)^use[ \\t]+(?:function[ \\t]+|const[ \\t]+)?([\\w\\\\]+)[ \\t]*;', 1)) AS target, 'import' AS ref_type FROM c
UNION ALL SELECT id, unnest(regexp_extract_all(content, '(?m)^(?:abstract |final )?class[ \\t]+\\w+[ \\t]+extends[ \\t]+([\\w\\\\]+)', 1)), 'inherits' FROM c"""
)
def php_refs(spark, root):
    c = table(spark, root, "chunks").where(F.col("file_path").rlike(r"(?i)\.php$")).select("id", "content").distinct()
    one = lambda pat, kind: c.select("id", F.explode(F.regexp_extract_all("content", F.lit(pat), F.lit(1))).alias("target"), F.lit(kind).alias("ref_type"))
    return one(r"(?m)^use[ \t]+(?:function[ \t]+|const[ \t]+)?([\w\\]+)[ \t]*;", "import").unionByName(one(r"(?m)^(?:abstract |final )?class[ \t]+\w+[ \t]+extends[ \t]+([\w\\]+)", "inherits"))


_PY_ALL = """WITH c AS (SELECT DISTINCT id, content FROM chunks WHERE regexp_matches(file_path, '(?i)\\.pyi?$')),
f AS (SELECT id, unnest(regexp_extract_all(content, '(?m)^from[ \\t]+([\\w.]+)[ \\t]+import[ \\t]+[^\\n]+$', 1)) AS module, unnest(regexp_extract_all(content, '(?m)^from[ \\t]+[\\w.]+[ \\t]+import[ \\t]+([^\\n]+)$', 1)) AS names FROM c),
n AS (SELECT id, module, trim(split_part(trim(unnest(string_split(trim(regexp_replace(names, '[ \\t]+#.*$', ''), '() \t'), ','))), ' as ', 1)) AS name FROM f),
k AS (SELECT id, unnest(regexp_extract_all(content, '(?m)^class[ \\t]+\\w+\\(([^)]+)\\)', 1)) AS bases FROM c),
b AS (SELECT id, trim(split_part(unnest(string_split(bases, ',')), '[', 1)) AS name FROM k)
SELECT id, module || '.' || name AS target, 'import' AS ref_type FROM n WHERE name <> '' AND name <> '*'
UNION ALL SELECT id, unnest(regexp_extract_all(content, '(?m)^import[ \\t]+([\\w.]+)', 1)), 'import' FROM c
UNION ALL SELECT id, name, 'inherits' FROM b WHERE name <> '' AND name <> 'object'
UNION ALL SELECT id, unnest(regexp_extract_all(content, '(?m)^@([\\w.]+)', 1)), 'decorator' FROM c"""


def _refs(spark: SparkSession, root: str, ending: str) -> DataFrame:
    """The references in every chunk of the files with this ending, by the extraction the index uses."""
    import pyarrow as pa

    from quarry.operators import references
    from quarry.sources.session import map_arrow

    def run(batches):
        for batch in batches:
            rows = [(i, target, kind) for i, path, text in zip(*[c.to_pylist() for c in batch.columns], strict=True) for _, target, kind in references.found(path, text or "")]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (zip(*rows, strict=True) if rows else ((), (), ()))], names=["id", "target", "ref_type"])

    c = table(spark, root, "chunks").where(F.col("file_path").rlike(ending) & ~F.col("file_path").rlike(r"(?i)\.blade\.php$"))
    return map_arrow(c.groupBy("id", "content").agg(F.min("file_path").alias("file_path")).select("id", "file_path", "content"), run, "id string, target string, ref_type string")


@query(_PY_ALL)
def python_refs_all(spark, root):
    """Imports of both forms, base classes and decorators of Python chunks."""
    return _refs(spark, root, r"(?i)\.pyi?$")


@query(
    """WITH c AS (SELECT DISTINCT id, content FROM chunks WHERE regexp_matches(file_path, '(?i)\\.(ts|tsx|js|jsx|mjs|cjs|vue)$')),
k AS (SELECT id, unnest(regexp_extract_all(content, 'import\\s+\\{([^}]+)\\}\\s+from\\s+[''"][^''"]+[''"]', 1)) AS names FROM c), m AS (SELECT id, unnest(string_split(names, ',')) AS n FROM k)
SELECT id, regexp_replace(split_part(regexp_replace(n, '^\\s+|\\s+$', '', 'g'), ' as ', 1), '\\s+$', '') AS target, 'import' AS ref_type FROM m WHERE regexp_replace(n, '\\s+', '', 'g') <> ''
UNION ALL SELECT id, unnest(regexp_extract_all(content, 'import\\s+(\\w+)\\s+from\\s+[''"][^''"]+[''"]', 1)), 'import' FROM c"""
)
def ts_refs_all(spark, root):
    """Named and default imports of TypeScript, JavaScript and Vue chunks."""
    return _refs(spark, root, r"(?i)\.(ts|tsx|js|jsx|mjs|cjs|vue)$")


@query(
    """WITH c AS (SELECT DISTINCT id, content FROM chunks WHERE regexp_matches(file_path, '(?i)\\.php$') AND NOT regexp_matches(file_path, '(?i)\\.blade\\.php$')),
b AS (SELECT id, unnest(regexp_extract_all(content, '\\b(?:class|interface)\\s+\\w+\\s+extends\\s+([\\w\\\\,\\s]+?)\\s*(?:\\{|implements\\b)', 1)) AS names FROM c
 UNION ALL SELECT id, unnest(regexp_extract_all(content, '\\bimplements\\s+([\\w\\\\,\\s]+?)\\s*\\{', 1)) FROM c),
n AS (SELECT id, ltrim(regexp_replace(unnest(string_split(names, ',')), '^\\s+|\\s+$', '', 'g'), '\\') AS name FROM b)
SELECT id, ltrim(unnest(regexp_extract_all(content, '(?m)^\\s*use\\s+(?:function\\s+|const\\s+)?([\\w\\\\]+)(?:\\s+as\\s+\\w+)?\\s*;', 1)), '\\') AS target, 'import' AS ref_type FROM c
UNION ALL SELECT id, name, 'inherits' FROM n WHERE name <> ''"""
)
def php_refs_all(spark, root):
    """Imports and the parents and interfaces of PHP chunks."""
    return _refs(spark, root, r"(?i)\.php$")


# Index upkeep.


@query("SELECT content, count(*) AS copies, min(id) AS first_id FROM (SELECT DISTINCT id, content FROM chunks) GROUP BY content HAVING count(*) > 1")
def dedup_by_content(spark, root):
    c = table(spark, root, "chunks").select("id", "content").distinct()
    return c.groupBy("content").agg(F.count("*").alias("copies"), F.min("id").alias("first_id")).where("copies > 1")


@query("SELECT repo, file_path, content_hash, loaded_at FROM (SELECT *, row_number() OVER (PARTITION BY repo, file_path ORDER BY loaded_at DESC, content_hash DESC) AS rn FROM file_hashes) WHERE rn = 1")
def upsert_last_wins(spark, root):
    f = table(spark, root, "file_hashes").select("repo", "file_path", "content_hash", "loaded_at")
    return index.latest(f, ["repo", "file_path"], ["loaded_at"])


@query("SELECT file_path, coalesce(array_to_string(list_sort(list(DISTINCT b) FILTER (WHERE b <> '')), ','), '') AS branches FROM (SELECT file_path, unnest(string_split(coalesce(branches, ''), ',')) AS b FROM chunks) GROUP BY file_path")
def branch_set_union(spark, root):
    return index.union_branches(table(spark, root, "chunks"), ["file_path"], "branches")


_SNAP = """f AS (SELECT DISTINCT ON (repo, file_path) repo, file_path, content_hash, mtime_ns FROM file_hashes ORDER BY repo, file_path, loaded_at DESC, content_hash DESC, mtime_ns DESC NULLS LAST),
cur AS (SELECT repo, file_path, CASE WHEN length(file_path) % 7 = 0 THEN content_hash || 'x' ELSE content_hash END AS h, CASE WHEN length(file_path) % 3 = 0 THEN mtime_ns + 1 ELSE mtime_ns END AS m FROM f WHERE length(file_path) % 10 <> 0),
old AS (SELECT repo, file_path, content_hash AS h, mtime_ns AS m FROM f WHERE length(file_path) % 11 <> 0)"""


def _snapshots(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    f = index.latest(table(spark, root, "file_hashes").select("repo", "file_path", "content_hash", "mtime_ns", "loaded_at"), ["repo", "file_path"], ["loaded_at"])
    n = F.length("file_path")
    h = F.when(n % 7 == 0, F.concat("content_hash", F.lit("x"))).otherwise(F.col("content_hash"))
    cur = f.where(n % 10 != 0).select("repo", "file_path", h.alias("h"), F.when(n % 3 == 0, F.col("mtime_ns") + 1).otherwise(F.col("mtime_ns")).alias("m"))
    return f.where(n % 11 != 0).select("repo", "file_path", F.col("content_hash").alias("h"), F.col("mtime_ns").alias("m")), cur


@query(f"WITH {_SNAP} SELECT repo, file_path, CASE WHEN o.h IS NULL THEN 'added' WHEN c.h IS NULL THEN 'deleted' WHEN o.h = c.h THEN 'unchanged' ELSE 'changed' END AS action FROM old o FULL JOIN cur c USING (repo, file_path)")
def diff_added_changed_deleted(spark, root):
    old, cur = _snapshots(spark, root)
    return index.difference(old, cur, ["repo", "file_path"], "h")


@query(
    f"""WITH {_SNAP} SELECT repo, file_path, CASE WHEN o.h IS NULL THEN 'added' WHEN c.h IS NULL THEN 'deleted' WHEN o.m = c.m THEN 'unchanged_mtime' WHEN o.h = c.h THEN 'unchanged_hash' ELSE 'changed' END AS action
FROM old o FULL JOIN cur c USING (repo, file_path)"""
)
def diff_mtime_fastpath(spark, root):
    old, cur = _snapshots(spark, root)
    return index.fast_difference(old, cur, ["repo", "file_path"], "m", "h")


@query(
    f"""WITH {_SNAP} SELECT repo, file_path, CASE WHEN o.h IS NULL THEN 'added' WHEN c.h IS NULL THEN 'deleted' WHEN o.h = c.h AND NOT regexp_matches(file_path, '\\.php$') THEN 'unchanged' ELSE 'changed' END AS action
FROM old o FULL JOIN cur c USING (repo, file_path)"""
)
def vec_dirty_force(spark, root):
    """As the difference, but files whose vectors are known to be stale (here: PHP) count as changed."""
    old, cur = _snapshots(spark, root)
    return index.difference(old, cur, ["repo", "file_path"], "h", forced=cur.where(F.col("file_path").rlike(r"\.php$")))


@query("SELECT doc_id FROM documents ANTI JOIN embeddings ON doc_id = vec_id WHERE length(trim(text)) > 0")
def embed_missing(spark, root):
    d = table(spark, root, "documents").where(F.length(F.trim("text")) > 0).select("doc_id")
    return d.join(table(spark, root, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")


@query(
    """WITH gone AS (SELECT DISTINCT id FROM chunks WHERE regexp_matches(file_path, '\\.sh$')) SELECT 'chunks' AS table_name, count(DISTINCT id) AS n FROM chunks WHERE NOT regexp_matches(file_path, '\\.sh$')
UNION ALL SELECT 'refs', count(DISTINCT ref_id) FROM refs WHERE source_chunk_id NOT IN (SELECT id FROM gone) AND source_chunk_id IS NOT NULL
UNION ALL SELECT 'symbol_lookup', count(*) FROM (SELECT DISTINCT repo, symbol_name, chunk_id FROM symbol_lookup WHERE chunk_id NOT IN (SELECT id FROM gone))"""
)
def cascade_delete(spark, root):
    """What is left when the shell files, their chunks, references and symbols are deleted."""
    c = table(spark, root, "chunks")
    gone = c.where(F.col("file_path").rlike(r"\.sh$")).select(F.col("id").alias("chunk_id"))
    r = table(spark, root, "refs").where("source_chunk_id is not null").withColumnRenamed("source_chunk_id", "chunk_id")
    s = table(spark, root, "symbol_lookup").select("repo", "symbol_name", "chunk_id").distinct()
    return (
        c.where(~F.col("file_path").rlike(r"\.sh$")).agg(F.lit("chunks").alias("table_name"), F.countDistinct("id").alias("n"))
        .unionByName(index.delete_files(r, gone, ["chunk_id"]).agg(F.lit("refs").alias("table_name"), F.countDistinct("ref_id").alias("n")))
        .unionByName(index.delete_files(s, gone, ["chunk_id"]).agg(F.lit("symbol_lookup").alias("table_name"), F.count("*").alias("n")))
    )


def _exclude_sql() -> str:
    import re as _re

    rx = "|".join("^" + "".join(".*" if c == "*" else "." if c == "?" else _re.escape(c) for c in p) + "$" for p in EXCLUDES)
    return f"regexp_matches(file_path, '{rx}') OR len(list_filter(string_split(file_path, '/'), lambda c: regexp_matches(c, '{rx}') OR regexp_matches(c || '/', '{rx}'))) > 0"


@query(f"SELECT DISTINCT repo, file_path, {_exclude_sql()} AS excluded FROM file_hashes")
def exclude_glob_filter(spark, root):
    return table(spark, root, "file_hashes").select("repo", "file_path", excluded(F.col("file_path"), EXCLUDES).alias("excluded")).distinct()


@query(
    f"""WITH z AS (SELECT repo, file_path, sum(length(content)) AS size FROM (SELECT DISTINCT repo, file_path, id, content FROM chunks WHERE coalesce(trim(parent_chunk_id), '') = '') GROUP BY ALL),
f AS (SELECT DISTINCT repo, file_path FROM file_hashes)
SELECT repo, file_path, CASE WHEN {_exclude_sql()} THEN 'excluded' WHEN size IS NULL OR size = 0 THEN 'empty' WHEN size > 5000 THEN 'too_large' ELSE 'indexable' END AS class FROM f LEFT JOIN z USING (repo, file_path)"""
)
def classify_candidates(spark, root):
    """Each known file as excluded, empty, too_large (here above 5,000 characters) or indexable."""
    c = table(spark, root, "chunks").where(F.coalesce(F.trim("parent_chunk_id"), F.lit("")) == "").select("repo", "file_path", "id", "content").distinct()
    z = c.groupBy("repo", "file_path").agg(F.sum(F.length("content")).alias("size"))
    f = table(spark, root, "file_hashes").select("repo", "file_path").distinct().join(z, ["repo", "file_path"], "left")
    kind = F.when(excluded(F.col("file_path"), EXCLUDES), "excluded").when(F.coalesce("size", F.lit(0)) == 0, "empty").when(F.col("size") > 5000, "too_large").otherwise("indexable")
    return f.select("repo", "file_path", kind.alias("class"))


# Status.


@query("SELECT repo, lower(trim(parse_mode)) AS mode, count(*) AS n_files FROM (SELECT DISTINCT repo, file_path, parse_mode FROM file_hashes) GROUP BY ALL")
def files_by_mode(spark, root):
    f = table(spark, root, "file_hashes").select("repo", "file_path", "parse_mode").distinct()
    return f.groupBy("repo", F.lower(F.trim("parse_mode")).alias("mode")).agg(F.count("*").alias("n_files"))


@query(
    """SELECT repo, count(DISTINCT file_path) AS n_files, count(DISTINCT id) AS n_chunks, count(DISTINCT id) FILTER (WHERE search_quality = 'ast') AS n_ast, count(DISTINCT id) FILTER (WHERE search_quality = 'regex') AS n_regex,
count(DISTINCT id) FILTER (WHERE search_quality = 'text_fallback') AS n_text, max(indexed_at) AS last_indexed FROM chunks GROUP BY repo"""
)
def status_rollup(spark, root):
    c = table(spark, root, "chunks")
    of = lambda q: F.countDistinct(F.when(F.col("search_quality") == q, F.col("id")))
    return c.groupBy("repo").agg(
        F.countDistinct("file_path").alias("n_files"), F.countDistinct("id").alias("n_chunks"), of("ast").alias("n_ast"), of("regex").alias("n_regex"), of("text_fallback").alias("n_text"), F.max("indexed_at").alias("last_indexed")
    )


@query("SELECT source, count(*) AS n_rows, count(vec_id) AS n_vectors, round(count(vec_id) / CAST(count(*) AS DOUBLE), 4) AS coverage FROM documents LEFT JOIN embeddings ON doc_id = vec_id GROUP BY source")
def coverage_share(spark, root):
    e = table(spark, root, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(1).alias("v"))
    j = table(spark, root, "documents").select("doc_id", "source").join(e, "doc_id", "left")
    return j.groupBy("source").agg(F.count("*").alias("n_rows"), F.count("v").alias("n_vectors"), F.round(F.count("v") / F.count("*"), 4).alias("coverage"))


@query("SELECT c.repo, count(DISTINCT id) AS n_chunks FROM chunks c ANTI JOIN (SELECT repo FROM repos WHERE state IS NOT NULL) r USING (repo) GROUP BY c.repo")
def orphan_indexes(spark, root):
    """Indexes, with their chunks, whose repository is not registered or has no state any more."""
    live = table(spark, root, "repos").where("state is not null").select("repo")
    return table(spark, root, "chunks").join(live, "repo", "left_anti").groupBy("repo").agg(F.countDistinct("id").alias("n_chunks"))


@query(
    """WITH c AS (SELECT repo, count(DISTINCT id) AS chunks, count(DISTINCT id) FILTER (WHERE search_quality = 'ast') AS ast, count(DISTINCT id) FILTER (WHERE search_quality = 'regex') AS regex,
 count(DISTINCT id) FILTER (WHERE search_quality = 'text_fallback') AS text_fallback, max(indexed_at) AS indexed_at FROM chunks GROUP BY repo),
f AS (SELECT repo, count(DISTINCT file_path) AS files, count(DISTINCT file_path) FILTER (WHERE coalesce(content_hash, '') = '') AS unhashed FROM file_hashes GROUP BY repo),
r AS (SELECT repo, count(DISTINCT ref_id) AS refs FROM refs GROUP BY repo), s AS (SELECT repo, count(DISTINCT symbol_name) FILTER (WHERE removed_at IS NULL) AS symbols FROM symbol_lookup GROUP BY repo)
SELECT repo, state, default_branch, main_lang, coalesce(files, 0) AS files, coalesce(unhashed, 0) AS unhashed, coalesce(chunks, 0) AS chunks, coalesce(ast, 0) AS ast, coalesce(regex, 0) AS regex, coalesce(text_fallback, 0) AS text_fallback,
 coalesce(refs, 0) AS refs, coalesce(symbols, 0) AS symbols, indexed_at FROM repos LEFT JOIN c USING (repo) LEFT JOIN f USING (repo) LEFT JOIN r USING (repo) LEFT JOIN s USING (repo)"""
)
def catalogue_rollup(spark, root):
    """One row per registered repository: state and counts of everything the index has of it."""
    t = lambda n: table(spark, root, n).groupBy("repo")
    of = lambda q: F.countDistinct(F.when(F.col("search_quality") == q, F.col("id"))).alias(q)
    c = t("chunks").agg(F.countDistinct("id").alias("chunks"), of("ast"), of("regex"), of("text_fallback"), F.max("indexed_at").alias("indexed_at"))
    f = t("file_hashes").agg(F.countDistinct("file_path").alias("files"), F.countDistinct(F.when(F.coalesce("content_hash", F.lit("")) == "", F.col("file_path"))).alias("unhashed"))
    r = t("refs").agg(F.countDistinct("ref_id").alias("refs"))
    s = t("symbol_lookup").agg(F.countDistinct(F.when(F.col("removed_at").isNull(), F.col("symbol_name"))).alias("symbols"))
    j = table(spark, root, "repos").join(c, "repo", "left").join(f, "repo", "left").join(r, "repo", "left").join(s, "repo", "left")
    n = [F.coalesce(x, F.lit(0)).alias(x) for x in ("files", "unhashed", "chunks", "ast", "regex", "text_fallback", "refs", "symbols")]
    return j.select("repo", "state", "default_branch", "main_lang", *n, "indexed_at")


_ALLOWED = {"symbol_type": "function method class_shell interface type_alias enum component variable module block section assignment".split(), "search_quality": ["ast", "regex", "text_fallback"]}


@query(
    "SELECT DISTINCT id, symbol_type NOT IN ({}) OR symbol_type IS NULL AS bad_type, search_quality NOT IN ({}) OR search_quality IS NULL AS bad_quality, coalesce(start_line > end_line OR start_line < 1, true) AS bad_lines FROM chunks "
    "WHERE symbol_type NOT IN ({}) OR symbol_type IS NULL OR search_quality NOT IN ({}) OR search_quality IS NULL OR coalesce(start_line > end_line OR start_line < 1, true) OR end_line - start_line > 60".format(
        *[", ".join(f"'{x}'" for x in _ALLOWED[k]) for k in ("symbol_type", "search_quality", "symbol_type", "search_quality")]
    )
)
def constraint_violations(spark, root):
    """Chunks that break a constraint of the index, and those of more than 60 lines, with what each breaks."""
    c = table(spark, root, "chunks")
    out = lambda k: ~F.col(k).isin(_ALLOWED[k]) | F.col(k).isNull()
    lines = F.coalesce((F.col("start_line") > F.col("end_line")) | (F.col("start_line") < 1), F.lit(True))
    rows = c.select("id", out("symbol_type").alias("bad_type"), out("search_quality").alias("bad_quality"), lines.alias("bad_lines"), (F.col("end_line") - F.col("start_line") > 60).alias("long"))
    return rows.where("bad_type or bad_quality or bad_lines or long").drop("long").distinct()


@query(
    "SELECT file_path, lower(file_path) AS key, row_number() OVER (ORDER BY file_path) AS place FROM (SELECT DISTINCT file_path FROM file_hashes WHERE file_path IS NOT NULL AND file_path <> '' AND NOT regexp_matches(file_path, '(^|/)[.][.](/|$)|^/|^[A-Za-z]:|[\\\\]'))"
)
def sorted_safe_paths(spark, root):
    """The paths that lie inside their repository, in order, numbered over all without one task holding them all."""
    from quarry.functions.ranks import spread_rank
    from quarry.functions.search import inside

    p = table(spark, root, "file_hashes").where(inside(F.col("file_path"))).select("file_path").distinct()
    ranked = spread_rank(p.withColumn("_g", F.lit(0)), ["_g"], "file_path")
    return ranked.select("file_path", F.lower("file_path").alias("key"), F.col("rank").cast("long").alias("place"))


# Streams and chunkers.


@query("SELECT repo, file_path, content_hash, loaded_at FROM (SELECT *, row_number() OVER (PARTITION BY repo, file_path ORDER BY loaded_at DESC, branch DESC, content_hash DESC) AS rn FROM file_hashes) WHERE rn = 1")
def stream_incremental_refresh(spark, root):
    """The last state of each file as a stream of file states keeps it."""
    from quarry.streaming.refresh import refresh_stream

    return refresh_stream(spark, f"{root}/file_hashes.parquet", ["repo", "file_path"], ["loaded_at"]).select("repo", "file_path", "content_hash", "loaded_at")


def _files(spark: SparkSession, root: str) -> DataFrame:
    """Files put together from their whole chunks, in line order."""
    c = table(spark, root, "chunks").where(F.coalesce(F.trim("parent_chunk_id"), F.lit("")) == "")
    parts = F.array_sort(F.collect_set(F.struct("start_line", "content")))
    g = c.groupBy("repo", "file_path").agg(parts.alias("p"))
    return g.select("repo", "file_path", F.array_join(F.transform("p", lambda x: x["content"]), "\n\n").alias("content"))


@query()
def chunk_source_files(spark, root):
    """Every file chunked anew by the structure of its language."""
    from quarry.operators.chunking import chunk_files

    return chunk_files(_files(spark, root)).drop("content")


@query(
    """WITH w AS (SELECT DISTINCT repo, file_path, start_line, content FROM chunks WHERE coalesce(trim(parent_chunk_id), '') = '' AND regexp_matches(file_path, '(?i)\\.(sh|bash)$')),
f AS (SELECT repo, file_path, string_split(string_agg(coalesce(content, ''), chr(10) || chr(10) ORDER BY start_line, content), chr(10)) AS a FROM w GROUP BY repo, file_path),
l AS (SELECT repo, file_path, unnest(range(1, len(a) + 1)) AS i, unnest(a) AS x FROM f),
n AS (SELECT *, regexp_extract(x, '^function\\s+(\\w+)', 1) || regexp_extract(x, '^(\\w+)\\s*\\(\\s*\\)', 1) AS name FROM l),
g AS (SELECT *, sum(CASE WHEN name <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY repo, file_path ORDER BY i) AS part FROM n),
b AS (SELECT repo, file_path, part, min(i) AS first, max(i) AS last FROM g WHERE trim(x, ' ' || chr(9) || chr(13)) <> '' GROUP BY ALL),
c AS (SELECT g.repo, g.file_path, g.part, coalesce(max(name) FILTER (WHERE name <> ''), '') AS symbol_name, CASE WHEN g.part = 0 THEN 'module' ELSE 'function' END AS symbol_type, string_agg(x, chr(10) ORDER BY i) AS content, CAST(any_value(first) AS INTEGER) AS start_line, CAST(any_value(last) AS INTEGER) AS end_line
 FROM g JOIN b ON g.repo = b.repo AND g.file_path = b.file_path AND g.part = b.part AND i BETWEEN first AND last GROUP BY g.repo, g.file_path, g.part),
m AS (SELECT *, substr(sha256(length(file_path) || ':' || file_path || '|' || length(symbol_name) || ':' || symbol_name || '|' || sha256(content)), 1, 32) AS id FROM c)
SELECT repo, id, file_path, symbol_name, symbol_type, arg_max(start_line, part) AS start_line, arg_max(end_line, part) AS end_line, CAST(NULL AS VARCHAR) AS parent_chunk_id, CAST(NULL AS INTEGER) AS sub_chunk_index, 'regex' AS search_quality
FROM m GROUP BY repo, id, file_path, symbol_name, symbol_type"""
)
def chunk_shell_files(spark, root):
    """Every shell file chunked anew, a function a chunk, none split."""
    from quarry.operators.chunking import chunk_files

    return chunk_files(_files(spark, root).where(F.col("file_path").rlike(r"(?i)\.(sh|bash)$")), 1 << 30).drop("content")


@query(
    """WITH w AS (SELECT DISTINCT repo, file_path, start_line, content FROM chunks WHERE coalesce(trim(parent_chunk_id), '') = '' AND regexp_matches(file_path, '(?i)\\.(md|markdown)$')),
f AS (SELECT repo, file_path, string_split(string_agg(coalesce(content, ''), chr(10) || chr(10) ORDER BY start_line, content), chr(10)) AS a FROM w GROUP BY repo, file_path),
l AS (SELECT repo, file_path, unnest(range(1, len(a) + 1)) AS i, unnest(a) AS x FROM f),
t AS (SELECT *, regexp_matches(x, '^\\s{0,3}(```|~~~)') AS mark FROM l),
n AS (SELECT *, NOT mark AND coalesce(sum(mark::INT) OVER (PARTITION BY repo, file_path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 0 AND regexp_matches(x, '^#{1,6}\\s+.+$') AS head FROM t),
g AS (SELECT *, sum(head::INT) OVER (PARTITION BY repo, file_path ORDER BY i) AS part FROM n),
b AS (SELECT repo, file_path, part, min(i) AS first, max(i) AS last FROM g WHERE trim(x, ' ' || chr(9) || chr(13)) <> '' GROUP BY ALL),
c AS (SELECT g.repo, g.file_path, g.part, CASE WHEN g.part = 0 THEN '' ELSE arg_min(regexp_replace(regexp_extract(x, '^#{1,6}\\s+(.+)$', 1), '^\\s+|\\s+$', '', 'g'), i) END AS symbol_name, CASE WHEN g.part = 0 THEN 'block' ELSE 'module' END AS symbol_type,
 string_agg(x, chr(10) ORDER BY i) AS content, CAST(any_value(first) AS INTEGER) AS start_line, CAST(any_value(last) AS INTEGER) AS end_line FROM g JOIN b ON g.repo = b.repo AND g.file_path = b.file_path AND g.part = b.part AND i BETWEEN first AND last GROUP BY g.repo, g.file_path, g.part),
m AS (SELECT *, substr(sha256(length(file_path) || ':' || file_path || '|' || length(symbol_name) || ':' || symbol_name || '|' || sha256(content)), 1, 32) AS id FROM c)
SELECT repo, id, file_path, symbol_name, symbol_type, arg_max(start_line, part) AS start_line, arg_max(end_line, part) AS end_line, CAST(NULL AS VARCHAR) AS parent_chunk_id, CAST(NULL AS INTEGER) AS sub_chunk_index, 'regex' AS search_quality
FROM m GROUP BY repo, id, file_path, symbol_name, symbol_type"""
)
def chunk_markdown_files(spark, root):
    """Every Markdown file chunked anew at its headings outside of fences, none split."""
    from quarry.operators.chunking import chunk_files

    return chunk_files(_files(spark, root).where(F.col("file_path").rlike(r"(?i)\.(md|markdown)$")), 1 << 30).drop("content")


_WS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_NEW = "(length({0}) - length(replace({0}, chr(10), '')))"


@query(
    f"""WITH RECURSIVE d AS (SELECT doc_id, source, string_split(regexp_replace(text, '([.!?])({_WS})', '\\1' || chr(1114109) || '\\2', 'g'), chr(1114109)) AS p FROM documents WHERE text IS NOT NULL),
q AS (SELECT doc_id, source, unnest(range(1, len(p) + 1)) AS k, unnest(p) AS x FROM d),
y AS (SELECT *, regexp_replace(x, '^{_WS}+|{_WS}+$', '', 'g') AS s, coalesce(sum({_NEW.format('x')}) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM q),
sent AS (SELECT doc_id, source, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i, s, length(s) AS n, 1 + above + {_NEW.format(f"regexp_extract(x, '^{_WS}*')")} AS line, {_NEW.format('s')} AS breaks FROM y WHERE s <> ''),
packs AS (SELECT doc_id, i, n AS size, 1 AS pack FROM sent WHERE i = 1 UNION ALL
 SELECT t.doc_id, t.i, CASE WHEN r.size + 1 + t.n > 500 THEN t.n ELSE r.size + 1 + t.n END, CASE WHEN r.size + 1 + t.n > 500 THEN r.pack + 1 ELSE r.pack END FROM packs r JOIN sent t ON t.doc_id = r.doc_id AND t.i = r.i + 1),
c AS (SELECT source, doc_id || '.txt' AS file_path, pack, string_agg(s, ' ' ORDER BY i) AS content, CAST(arg_min(line, i) AS INTEGER) AS start_line, CAST(arg_max(line + breaks, i) AS INTEGER) AS end_line FROM packs JOIN sent USING (doc_id, i) GROUP BY source, doc_id, pack),
m AS (SELECT *, substr(sha256(length(file_path) || ':' || file_path || '|0:|' || sha256(content)), 1, 32) AS id FROM c)
SELECT source AS repo, id, file_path, '' AS symbol_name, 'block' AS symbol_type, arg_max(start_line, pack) AS start_line, arg_max(end_line, pack) AS end_line, CAST(NULL AS VARCHAR) AS parent_chunk_id, CAST(NULL AS INTEGER) AS sub_chunk_index, 'text_fallback' AS search_quality
FROM m GROUP BY source, id, file_path"""
)
def prose_pack(spark, root):
    """Documents packed into pieces of whole sentences of at most 500 characters."""
    from quarry.operators.chunking import chunk_files

    d = table(spark, root, "documents").where("text is not null")
    return chunk_files(d.select(F.col("source").alias("repo"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_path"), F.col("text").alias("content")), 500).drop("content")


# Further upkeep.


@query(f"WITH {_SNAP}, dirty AS (SELECT repo, file_path, h || 'd' AS sha FROM cur WHERE length(file_path) % 9 = 0 UNION SELECT repo, file_path || '.new', h FROM cur WHERE length(file_path) % 23 = 0) SELECT repo, file_path, coalesce(d.sha, c.h) AS sha FROM cur c FULL JOIN dirty d USING (repo, file_path)")
def dirty_overlay(spark, root):
    """The committed tree with the working copy's changed and new files over it."""
    _, cur = _snapshots(spark, root)
    n = F.length("file_path")
    dirty = cur.where(n % 9 == 0).select("repo", "file_path", F.concat("h", F.lit("d")).alias("sha")).union(cur.where(n % 23 == 0).select("repo", F.concat("file_path", F.lit(".new")), "h")).distinct()
    return cur.join(dirty, ["repo", "file_path"], "full").select("repo", "file_path", F.coalesce("sha", "h").alias("sha"))


@query(
    """WITH c AS (SELECT DISTINCT id, coalesce(branches, '') AS branches FROM chunks)
SELECT id, branches, array_to_string(list_sort(list_distinct(list_filter(string_split(branches, ',') || ['nightly'], lambda b: b <> ''))), ',') AS updated FROM c"""
)
def branch_only_update(spark, root):
    """Unchanged chunks gain a branch; the list is kept sorted and without repeats."""
    c = table(spark, root, "chunks").select("id", F.coalesce("branches", F.lit("")).alias("branches")).distinct()
    merged = F.array_sort(F.array_union(F.filter(F.split("branches", ","), lambda b: b != ""), F.array(F.lit("nightly"))))
    return c.select("id", "branches", F.array_join(merged, ",").alias("updated"))


@query("SELECT file_path, content_hash FROM (SELECT DISTINCT repo, file_path, content_hash FROM file_hashes WHERE branch = 'develop')")
def hashes_of_branch(spark, root):
    return table(spark, root, "file_hashes").where("branch = 'develop'").select("repo", "file_path", "content_hash").distinct().select("file_path", "content_hash")


@query("SELECT source_chunk_id, list_sort(list(DISTINCT target_symbol)) AS targets, count(*) AS n FROM refs WHERE source_chunk_id IS NOT NULL AND target_symbol IS NOT NULL GROUP BY source_chunk_id")
def refs_of_chunks(spark, root):
    """The distinct targets and the number of reference rows of each chunk; one group is one chunk's references."""
    r = table(spark, root, "refs").where("source_chunk_id is not null and target_symbol is not null")
    return r.groupBy("source_chunk_id").agg(F.array_sort(F.collect_set("target_symbol")).alias("targets"), F.count("*").alias("n"))


@query("SELECT repo, target_symbol, min(ref_id) AS first_ref FROM refs WHERE target_symbol IS NOT NULL GROUP BY repo, target_symbol")
def ordered_distinct_targets(spark, root):
    return table(spark, root, "refs").where("target_symbol is not null").groupBy("repo", "target_symbol").agg(F.min("ref_id").alias("first_ref"))


@query("SELECT DISTINCT repo, file_path FROM file_hashes EXCEPT SELECT DISTINCT repo, file_path FROM chunks")
def files_without_chunks(spark, root):
    f, c = (table(spark, root, n).select("repo", "file_path").distinct() for n in ("file_hashes", "chunks"))
    return f.exceptAll(c)


@query(
    """WITH h AS (SELECT DISTINCT repo, content_hash FROM file_hashes WHERE content_hash IS NOT NULL AND content_hash <> '')
SELECT a.repo AS repo_a, b.repo AS repo_b, count(*) AS n_shared FROM h a JOIN h b ON a.content_hash = b.content_hash AND a.repo < b.repo GROUP BY ALL"""
)
def identity_overlap(spark, root):
    """Pairs of repositories that share contents, with how many: what tells copies of one repository apart from strangers.

    A content is held by at most as many rows as there are repositories."""
    h = table(spark, root, "file_hashes").where("content_hash is not null and content_hash <> ''").select("repo", "content_hash").distinct()
    a, b = h.alias("a"), h.alias("b")
    j = a.join(b, (F.col("a.content_hash") == F.col("b.content_hash")) & (F.col("a.repo") < F.col("b.repo")))
    return j.groupBy(F.col("a.repo").alias("repo_a"), F.col("b.repo").alias("repo_b")).agg(F.count("*").alias("n_shared"))


@query("SELECT symbol_type, count(*) AS n_chunks, round(avg(end_line - start_line + 1), 6) AS mean_lines, max(end_line - start_line + 1) AS most_lines FROM (SELECT DISTINCT id, symbol_type, start_line, end_line FROM chunks) GROUP BY symbol_type")
def chunks_by_type(spark, root):
    c = table(spark, root, "chunks").select("id", "symbol_type", (F.col("end_line") - F.col("start_line") + 1).alias("lines"), "start_line", "end_line").distinct()
    return c.groupBy("symbol_type").agg(F.count("*").alias("n_chunks"), F.round(F.avg("lines"), 6).alias("mean_lines"), F.max("lines").alias("most_lines"))
