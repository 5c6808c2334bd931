"""Searches of whole tables: equal to their SQL on odd rows, and what they shuffle stays below the texts, however many queries share their words."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quarry.operators import vectors

WORDS = ["the", "how", "do", "we", "Café", "scan", "table", "full", "index", "x1"]


def shuffled(spark) -> int:
    """Bytes that all stages so far have written for a shuffle."""
    sc, gateway = spark.sparkContext, spark.sparkContext._gateway
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def tables(spark, place: str, chunks: int, queries: int, odd: bool) -> int:
    """Chunks and queries of few words; the bytes of the contents."""
    r = random.Random(7)
    text = lambda n: r.choice(["", "-"]) + r.choice([" ", "_", " "]).join(r.choices(WORDS, k=n))
    c = [(f"r{i % 3}", f"id{i:05}", text(r.randrange(40, 90)), f"src/{r.choice(WORDS)}.py", r.choice(["FullScan", "TableIndex", None]), r.choice(["ast", "regex", None])) for i in range(chunks)]
    q = [(i, f"r{i % 3}", text(r.randrange(1, 5)) + r.choice(["", " FullScan"]), 10) for i in range(queries)]
    if odd:
        c += [c[0], ("r0", c[3][1], "zebra scan", None, "FullScan", "ast"), ("r1", c[0][1], c[0][2], None, None, None), ("r0", "empty", "", "", "", ""), ("r2", "none", None, None, None, None), (None, "lost", "scan", None, None, None)]
        c += [("r1", f"id{i}", "rare_scan here", None, None, None) for i in range(20)]
        q += [(90001, "r0", None, 5), (90002, "r1", " \" ", 5), (90003, None, "scan", 5), (90004, "nowhere", "scan", 5), (90005, "r1", "rare-scan", 3), (90006, "r0", "zebra", 3), (90007, "r0", "absent scan", 3)]
        q += [(90008, "r0", "scan the", 5), (90008, "r1", "scan the", 5)]
    spark.createDataFrame(c, "repo string, id string, content string, file_path string, symbol_name string, search_quality string").repartition(3).write.parquet(f"{place}/chunks.parquet")
    spark.createDataFrame(q, "query_id long, repo string, query_text string, top_k int").write.parquet(f"{place}/queries.parquet")
    return sum(len(x[2] or "") for x in c)


def by_sql(name: str, place: str) -> list:
    import duckdb

    con = duckdb.connect()
    for t in ("chunks", "queries"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{place}/{t}.parquet/*.parquet'")
    return sorted(map(str, con.sql(__spark_entry__.oracle_sql()[name]).fetchall()))


@pytest.mark.parametrize("block", [20_000, 50])
def test_bm25_of_all_queries_equals_its_sql_on_odd_rows(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr("quarry.operators.bm25.BLOCK", block)
    tables(spark, str(tmp_path), 200, 120, odd=True)
    got = [tuple(x) for x in __spark_entry__.queries()["bm25_query_batch"](spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == by_sql("bm25_query_batch", str(tmp_path)) and {90005, 90006, 90008} <= {x[0] for x in got}


def test_bm25_of_all_queries_shuffles_less_than_the_texts(spark, tmp_path):
    size, before = tables(spark, str(tmp_path), 1500, 600, odd=False), shuffled(spark)
    assert __spark_entry__.queries()["bm25_query_batch"](spark, str(tmp_path)).count() > 0
    assert shuffled(spark) - before < size


@pytest.mark.parametrize("block", [20_000, 50])
def test_fused_search_equals_its_sql(spark, tmp_path, monkeypatch, block):
    for m in ("bm25", "vectors"):
        monkeypatch.setattr(f"quarry.operators.{m}.BLOCK", block)
    tables(spark, str(tmp_path), 200, 120, odd=False)
    assert sorted(str(tuple(x)) for x in __spark_entry__.queries()["fused_search"](spark, str(tmp_path)).collect()) == by_sql("fused_search", str(tmp_path))


@pytest.mark.parametrize("metric", ["dot", "l2"])
def test_nearest_rows_of_many_tasks_are_few_to_shuffle(spark, metric):
    """16 tasks, 200 queries, the 50 best of each; coordinates of few values, so that scores tie."""
    import numpy as np

    rows = spark.range(0, 4000, 1, 16).select(F.lit(0).alias("grp"), F.col("id").alias("key"), F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: F.pmod(F.xxhash64("id", j), F.lit(5)).cast("double")).alias("x"))
    ask, before = rows.where("key < 200").withColumnRenamed("key", "query_id"), shuffled(spark)
    got = [tuple(r) for r in vectors.search(rows, ask, 50, metric).select("query_id", "rank", "key").collect()]
    assert shuffled(spark) - before < 1_000_000
    v = np.array([r["x"] for r in rows.orderBy("key").collect()])
    s = -v[:200] @ v.T if metric == "dot" else ((v[:200, None] - v[None]) ** 2).sum(axis=2)
    assert sorted(got) == [(q, k + 1, int(x)) for q in range(200) for k, x in enumerate(np.argsort(s[q], kind="stable")[:50])]
