import os

import pytest
from pyspark.sql import functions as F

from quarry.functions.ranks import spread_rank
from quarry.functions.search import chunk_id, phrases, symbol_candidates, symbol_weight
from quarry.functions.text import packed_values
from quarry.operators import bm25, fusion, graph, index, vectors
from quarry.operators.chunking import chunk_file, identity, signature
from quarry.operators.orphans import dangling
from quarry.operators.packed import split_packed

PACKED = [
    (None, []), ("", []), (" , ;", []), ("main", ["main"]), ("a,b", ["a", "b"]), ("a ; b|c", ["a", "b", "c"]), ('["main", "release/5.4"]', ["main", "release/5.4"]),
    ("{main,release/2.0}", ["main", "release/2.0"]), ('"hotfix/fence, block",main', ["hotfix/fence, block", "main"]), ('"fix/task""zij"', ['fix/task"zij']),
    ("'it''s',x", ["it's", "x"]), ("a,a,a", ["a", "a", "a"]), ("main;;main;", ["main", "main"]), ("develop, \"fokusoste's rate\", x", ["develop", "fokusoste's rate", "x"]),
    ("issue#153", ["issue#153"]), ('"open,b', ["open", "b"]), ("0,\"q\"", ["0", "q"]), ("a\r\nb\tc", ["a", "b", "c"]), ('"[x]",[y]', ["[x]", "y"]),
]


def test_packed_values(spark):
    df = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(PACKED)], "i int, p string")
    got = {r["i"]: r["v"] for r in df.select("i", packed_values(F.col("p")).alias("v")).collect()}
    for i, (p, want) in enumerate(PACKED):
        assert got[i] == want, p


def test_split_packed_takes_the_latest_row_and_counts_positions(spark):
    df = spark.createDataFrame([("a", "x,y", 1), ("a", "z,y,y", 2), ("b", "q", 1), (None, "m,n", 1), ("c", None, 1)], "id string, branches string, t int")
    rows = sorted(tuple(r) for r in split_packed(df, "id", "branches", "t", 2).collect())
    assert rows == [("a", 1, "z"), ("a", 2, "y"), ("a", 3, "y")]


def test_dangling(spark):
    chunks = spark.createDataFrame([("r", "AB1", None), ("r", "ab2", " AB1 "), ("r", "ab3", "gone"), ("r", "ab3", "gone"), ("s", "ab4", "")], "repo string, id string, parent_chunk_id string").withColumn("indexed_at", F.lit("2025-01-01").cast("timestamp"))
    symbols = spark.createDataFrame([("r", " Alpha.run ", None), ("r", "Beta", "2025-01-02"), ("s", "gamma", None), ("r", " ", None)], "repo string, symbol_name string, removed_at string").withColumn("indexed_at", F.lit("2025-01-01").cast("timestamp"))
    refs = [
        (1, "r", "ab1", "m.Alpha.RUN()"), (2, "r", " AB2", "@run"), (3, "r", "zz", "beta"), (4, "s", "ab4", "x::gamma"), (5, "r", "ab1", "gamma"), (6, "r", None, " "), (6, "r", None, " "),
        (7, None, "ab1", "alpha.run"), (8, "r", "ab1", "App\\Alpha.run"),
    ]
    r = spark.createDataFrame(refs, "ref_id long, repo string, source_chunk_id string, target_symbol string").withColumn("seen_at", F.lit("2025-01-01").cast("timestamp"))
    got = sorted((x["field_name"], x["row_key"]) for x in dangling(r, chunks, symbols).collect())
    assert got == [("parent_chunk_id", "ab3"), ("source_chunk_id", "3"), ("target_symbol", "2"), ("target_symbol", "3"), ("target_symbol", "5"), ("target_symbol", "7")]


def test_spread_rank_equals_the_window(spark):
    """One group holds a third of all rows, a third of these tied."""
    from pyspark.sql import Window

    df = spark.range(5000).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 3 == 0, F.col("id") * 7 % 501).when(F.col("id") % 9 == 1, 5).otherwise(F.col("id")).alias("m"), F.col("id").alias("k"))
    w = Window.partitionBy("g")
    want = df.withColumn("rank", F.rank().over(w.orderBy("m"))).withColumn("n", F.count("*").over(w))
    assert sorted(map(tuple, spread_rank(df, ["g"], "m").collect())) == sorted(map(tuple, want.collect()))
    both = df.withColumn("rank", F.rank().over(w.orderBy("m", "k"))).withColumn("n", F.count("*").over(w))
    assert sorted(map(tuple, spread_rank(df, ["g"], "m", "k").collect())) == sorted(map(tuple, both.collect()))
    assert spread_rank(df.limit(0), ["g"], "m").collect() == []


def test_bm25_phrases_and_ties(spark):
    rows = spark.createDataFrame([(0, "a", "full table scan", "x"), (0, "b", "table full", "full table"), (0, "c", "Café table", ""), (0, "d", None, None)], "grp int, id string, content string, path string")
    q = spark.createDataFrame([(1, 0, "full-table"), (2, 0, "cafe"), (3, 0, '"?" table'), (4, 0, None), (5, 0, "full scan")], "query_id int, grp int, query_text string")
    cols = ["content", "path"]
    out = bm25.search(bm25.postings(rows, F.col("grp"), "id", cols), bm25.lengths(rows, F.col("grp"), "id", cols), q, 10)
    got = {}
    for r in out.collect():
        got.setdefault(r["query_id"], set()).add(r["key"])
    assert got == {1: {"a", "b"}, 2: {"c"}, 3: {"a", "b", "c"}, 5: {"a"}}


def test_query_classification(spark):
    texts = ["UserService", "validate_email", "how does authentication work", "AuthService.validate", None, " ", "getUser (FooBar),"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", F.round(symbol_weight(F.col("t")), 6).alias("w"), symbol_candidates(F.col("t")).alias("c"), phrases(F.col("t")).alias("p"))
    got = {r["i"]: r for r in df.collect()}
    assert [got[i]["w"] for i in range(7)] == [0.3, 0.2, -0.2, 0.2, 0.0, 0.0, 0.4]
    assert got[6]["c"] == ["getUser", "FooBar"] and got[4]["p"] == []


def test_reciprocal_fusion(spark):
    one = lambda rows: spark.createDataFrame([(0, c, k, "ast") for k, c in enumerate(rows, 1)], "query_id int, chunk_id string, rank int, search_quality string")
    none = one(["x"]).where("false")
    got = {r["chunk_id"]: (round(r["score"], 9), r["reason"]) for r in fusion.reciprocal(one(["a", "b"]), one(["b", "c"]), none).collect()}
    assert got == {"a": (round(1 / 16, 9), "bm25"), "b": (round(1 / 17 + 1 / 16, 9), "bm25+vector"), "c": (round(1 / 17, 9), "vector")}
    sym = {r["chunk_id"]: r["reason"] for r in fusion.full_text_only(one(["a"]).withColumn("score", F.lit(5.0)), one(["a", "z"])).collect()}
    assert sym == {"a": "bm25+symbol", "z": "symbol_exact"}


def test_branch_members(spark):
    df = spark.createDataFrame([("a", "main"), ("b", "main,feature"), ("c", "feature-old"), ("d", ""), ("e", None)], "id string, branches string")
    assert {r["id"] for r in index.on_branch(df, "branches", "feature").collect()} == {"b", "d", "e"}


def test_difference(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("e", None)], "p string, h string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1"), ("e", None)], "p string, h string")
    got = {r["p"]: r["action"] for r in index.difference(old, new, ["p"], "h").collect()}
    assert got == {"a": "unchanged", "b": "changed", "c": "deleted", "d": "added", "e": "unchanged"}
    forced = {r["p"]: r["action"] for r in index.difference(old, new, ["p"], "h", new.where("p = 'a'")).collect()}
    assert forced["a"] == "changed"


def test_expansion_skips_present_chunks(spark):
    chunks = spark.createDataFrame([("c1", "ast"), ("c2", "regex"), ("c3", "ast")], "id string, search_quality string")
    symbols = spark.createDataFrame([("r", "f", "c2", None), ("r", "f", "c3", None), ("r", "g", "c1", None)], "repo string, symbol_name string, chunk_id string, removed_at string")
    refs = spark.createDataFrame([("r", "c1", "f"), ("r", "c1", "f"), ("r", "c1", None)], "repo string, source_chunk_id string, target_symbol string")
    seeds = spark.createDataFrame([(0, "c1", 1)], "query_id int, chunk_id string, position int")
    got = [(r["chunk_id"], r["slot"]) for r in graph.expand(seeds, seeds.select("query_id", "chunk_id"), refs, symbols, chunks).orderBy("slot").collect()]
    assert got == [("c3", 1), ("c2", 2)]


def test_nearest_and_bag_of_words(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0]), (4, None), (5, [1.0, 0.0])], "id int, e array<double>")
    assert [r["key"] for r in vectors.nearest(v, "id", "e", [1.0, 0.0], 2).orderBy("rank").collect()] == [1, 5]
    w = vectors.bag_of_words(spark.createDataFrame([(1, "user user"), (2, ""), (3, None)], "id int, t string"), "id", "t")
    assert [(r["key"], r["bucket"], r["value"]) for r in w.collect()] == [(1, 46, 1.0)]


PY = '"""Doc."""\nimport os\n\nLIMIT = 5\n\n\n@wrap\ndef f(a,\n      b):\n    return a\n\n\nclass C(B):\n    """What."""\n    x = 1\n\n    def m(self):\n        return 2\n'


def test_python_chunks():
    got = [(c.symbol_name, c.symbol_type, c.start_line, c.end_line, c.quality) for c in chunk_file("a.py", PY)]
    assert got == [("", "module", 1, 4, "ast"), ("f", "function", 7, 10, "ast"), ("C", "class_shell", 13, 18, "ast"), ("C.m", "method", 17, 18, "ast")]
    assert {c.quality for c in chunk_file("a.py", "def (:\n\nx")} == {"text_fallback"}


def test_other_chunkers():
    ts = "import { a } from 'x';\n\n// note {\nexport function go(a: string): void {\n  if (a) { b(); }\n}\n\nexport class K {\n  x = 1;\n  async run(): Promise<void> {\n    y();\n  }\n}\n\nexport const Card = ({ t }: P) => {\n  return <b>{t}</b>;\n};\n"
    got = [(c.symbol_name, c.symbol_type, c.start_line, c.end_line) for c in chunk_file("a.tsx", ts)]
    assert got == [("", "module", 1, 1), ("go", "function", 3, 6), ("K", "class_shell", 8, 13), ("K.run", "method", 10, 12), ("Card", "component", 15, 17)]
    assert [c.symbol_name for c in chunk_file("a.sh", "set -e\nfunction f {\n x\n}\ng() {\n y\n}\n")] == ["", "f", "g"]
    assert [c.symbol_name for c in chunk_file("a.md", "intro\n# A\ntext\n```\n# no\n```\n## B\nmore")] == ["", "A", "B"]
    assert [c.symbol_name for c in chunk_file("v.blade.php", "<p>\n@section('content')\n @if (x)\n a\n @endif\n@endsection\nend")] == ["", "section:content", ""]
    assert [c.symbol_name for c in chunk_file("v.vue", "<template>\n<b/>\n</template>\n<script>\nfunction q() {\n}\n</script>\n")] == ["template", "q"]
    assert [(c.symbol_name, c.symbol_type) for c in chunk_file("a.php", "<?php\nuse A;\n\n/** d */\nclass X\n{\n    public function m()\n    {\n    }\n}\n")] == [("", "module"), ("X", "class_shell"), ("X.m", "method")]
    assert chunk_file("a.py", " \n") == [] and chunk_file("x", "a\n\nb")[1].content == "b"


def test_long_chunks_are_split_and_keep_their_signature():
    text = "def f(a,\n      b):\n" + "\n".join(f"    value_{i} = {i}" for i in range(400)) + "\n"
    parts = chunk_file("a.py", text, 1000)
    assert len(parts) > 5 and all(len(p.content) <= 1100 for p in parts) and all(p.content.startswith("def f(a,") for p in parts)
    assert {p.parent for p in parts} == {identity("a.py", "f", text.rstrip())} and [p.place for p in parts] == list(range(len(parts)))
    assert signature(["def f(a,", "  b):", "  x"]) == ["def f(a,", "  b):"]


def test_chunk_id_in_spark_and_python(spark):
    df = spark.createDataFrame([("é/a.py", "f", "text\n")], "p string, s string, c string")
    assert df.select(chunk_id(F.col("p"), F.col("s"), F.col("c"))).first()[0] == identity("é/a.py", "f", "text\n")


def test_index_end_to_end(spark, tmp_path):
    from quarry.engine import Index
    from quarry.sources.discover import scan_files

    src = tmp_path / "src"
    (src / "lib").mkdir(parents=True)
    (src / "node_modules").mkdir()
    (src / "lib" / "auth.py").write_text("def validate_token(token):\n    return token.strip()\n\n\nclass UserService:\n    def login(self):\n        return validate_token('x')\n")
    (src / "notes.md").write_text("# Tokens\nHow a token is renewed\n")
    (src / "node_modules" / "x.js").write_text("var a;")
    (src / "empty.py").write_text("")
    files = scan_files(spark, str(src), "demo")
    assert {r["file_path"] for r in files.select("file_path").collect()} == {"lib/auth.py", "notes.md"}
    ix = Index(spark, str(tmp_path / "ix"))
    assert ix.build(files, "main")["files"] == 2
    hits = ix.query("token renewed", repo="demo").collect()
    assert [h["symbol_name"] for h in hits] == ["Tokens"] and hits[0]["match_reason"] == "bm25"
    assert ix.query("UserService").first()["match_reason"] == "bm25+symbol"
    assert ix.query("token", branch="other").collect() == []
    (src / "notes.md").write_text("# Tokens\nHow a session is renewed\n")
    (src / "lib" / "auth.py").unlink()
    (src / "new.sh").write_text("go() {\n echo hi\n}\n")
    assert ix.refresh(scan_files(spark, str(src), "demo")) == {"added": 1, "changed": 1, "unchanged": 0, "deleted": 1}
    assert ix.query("token renewed").collect() == [] and len(ix.query("session renewed").collect()) == 1
    with pytest.raises(ValueError):
        ix.query("x", top_k=0)


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["query_id", "key", "score", "rank"]


def _canon(cols, rows):
    def one(x):
        if isinstance(x, float):
            return None if x != x else round(x, 7)
        return tuple(one(y) for y in x) if isinstance(x, (list, tuple)) else x

    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted((tuple(one(r[i]) for i in order) for r in rows), key=repr)


def _names():
    from quarry.plans import core_queries, reference_queries

    return sorted({**core_queries.oracle_sql(), **reference_queries.oracle_sql()})


@pytest.mark.parametrize("name", _names())
def test_against_sql(spark, name):
    import duckdb

    from quarry.plans import core_queries, reference_queries

    root = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for f in os.listdir(root):
        con.sql(f"create view {f.split('.')[0]} as select * from '{root}/{f}'")
    df = {**core_queries.queries(), **reference_queries.queries()}[name](spark, root)
    rel = con.sql({**core_queries.oracle_sql(), **reference_queries.oracle_sql()}[name])
    assert _canon(df.columns, [tuple(r) for r in df.collect()]) == _canon(rel.columns, rel.fetchall())


@pytest.mark.parametrize("name", ["p4_found", "p4_by_period", "p5_found", "p5_branch_counts"])
def test_empty_and_hostile_tables(spark, empty_tables, hostile_tables, name):
    from quarry.plans.core_queries import queries

    assert queries()[name](spark, empty_tables).collect() == []
    df = queries()[name](spark, hostile_tables)
    assert df.count() == df.distinct().count() > 0
