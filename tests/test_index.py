"""The index: versions, locks, incremental refresh, references, expansion; streams that are run again; git."""

import json
import os
import shutil
import subprocess
import time

import pytest
from pyspark.sql import functions as F

from quarry import engine
from quarry.engine import Index, Locked, catalogue
from quarry.functions.search import inside
from quarry.operators import references
from quarry.operators.chunking import chunk_and_refer, chunk_file, chunk_files
from quarry.sources import git
from quarry.sources.config import Settings
from quarry.sources.tables import shared_dir
from quarry.streaming.refresh import refresh_stream

FILES = {
    "src/store.py": "import os\n\n\nclass TokenStore:\n    def load_token(self, name):\n        return os.environ[name]\n",
    "src/login.py": "from src.store import TokenStore\n\n\ndef check_login(user):\n    store = TokenStore()\n    return store.load_token(user)\n",
    "src/audit.py": "from src.store import TokenStore\n\n\ndef write_audit(event):\n    return TokenStore().load_token(event)\n",
}


def frame(spark, files, repo="r"):
    rows = [(repo, p, t, f"{hash(t):x}" if t is not None else "lost") for p, t in files.items()]
    return spark.createDataFrame(rows, "repo string, file_path string, content string, content_hash string")


@pytest.fixture
def built(spark, tmp_path):
    i = Index(spark, f"file://{tmp_path}/index", embed=lambda c: F.array(F.length(c).cast("double"), F.lit(1.0)))
    i.build(frame(spark, FILES), "main", {"root_commits": ["a"]})
    return i


def test_references_and_symbols_are_indexed(built):
    refs = {(r["target_symbol"], r["ref_type"]) for r in built.table("refs").collect()}
    assert ("src.store.TokenStore", "import") in refs and ("os", "import") in refs
    assert {"TokenStore", "TokenStore.load_token", "check_login"} <= {r["symbol_name"] for r in built.table("symbols").collect()}
    s = built.status()
    assert s["files"] == 3 and s["refs"] == 3 and s["vectors"] == s["chunks"] and s["coverage"] == 1.0 and s["ast"] == s["chunks"]


def test_refresh_carries_over_what_did_not_change(built, spark, monkeypatch):
    seen = []
    monkeypatch.setattr(engine, "chunk_and_refer", lambda files, limit: seen.append([r[0] for r in files.select("file_path").collect()]) or chunk_and_refer(files, limit))
    old = {r["chunk_id"] for r in built.table("vectors").collect()}
    now = {**FILES, "src/login.py": FILES["src/login.py"] + "\n\ndef log_out(user):\n    return None\n", "src/new.py": "def fresh_thing():\n    return 1\n"}
    del now["src/audit.py"]
    assert built.refresh(frame(spark, now), "dev") == {"added": 1, "changed": 1, "unchanged": 1, "deleted": 1}
    assert sorted(seen[0]) == ["src/login.py", "src/new.py"]
    again = Index(spark, built.place + "2", built.embed)
    again.build(frame(spark, now))
    for name, keys in (("postings", ["grp", "key", "col", "pos", "term"]), ("lengths", ["grp", "key", "dl"]), ("vectors", ["repo", "chunk_id", "embedding"]), ("refs", ["repo", "file_path", "source_chunk_id", "target_symbol"]), ("symbols", ["symbol_name", "chunk_id"])):
        rows = [sorted(map(str, i.table(name).select(*keys).collect())) for i in (built, again)]
        assert rows[0] == rows[1], name
    assert old & {r["chunk_id"] for r in built.table("vectors").collect()}
    branches = {r["file_path"]: r["branches"] for r in built.table("chunks").collect()}
    assert branches == {"src/store.py": "dev,main", "src/login.py": "dev", "src/new.py": "dev"}


def test_unread_files_keep_their_rows_and_others_stay(built, spark):
    before = {r["id"] for r in built.table("chunks").where("file_path = 'src/login.py'").collect()}
    assert built.refresh(frame(spark, {**FILES, "src/login.py": None}))["failed"] == 1
    assert {r["id"] for r in built.table("chunks").where("file_path = 'src/login.py'").collect()} == before
    only = spark.createDataFrame([("r", "src/audit.py")], "repo string, file_path string")
    got = built.refresh(frame(spark, {"src/audit.py": "def other():\n    return 2\n"}), only=only)
    assert got == {"added": 0, "changed": 1, "unchanged": 0, "deleted": 0} and built.status()["files"] == 3
    assert built.refresh(frame(spark, {}), only=only)["deleted"] == 1 and {r["file_path"] for r in built.table("chunks").collect()} == {"src/store.py", "src/login.py"}


def test_a_writer_that_stops_leaves_the_index_as_it_was(built, spark, monkeypatch):
    before = sorted(map(str, built.table("chunks").collect()))
    monkeypatch.setattr(Index, "_publish", lambda self, state: (_ for _ in ()).throw(OSError("stopped")))
    with pytest.raises(OSError):
        built.refresh(frame(spark, {}))
    monkeypatch.undo()
    assert sorted(map(str, built.table("chunks").collect())) == before and built._pointers() == [1]
    assert built.refresh(frame(spark, {}))["deleted"] == 3 and built._pointers() == [1, 2]
    built.refresh(frame(spark, FILES))
    assert built.clean(keep=1) == ["current.1", "current.2", "v1", "v2"] and built.status()["files"] == 3


def test_one_writer_at_a_time(built, spark):
    place = built.place.removeprefix("file://")
    with built._writing():
        with pytest.raises(Locked):
            built.refresh(frame(spark, FILES))
    assert not os.path.exists(f"{place}/lock")
    with open(f"{place}/lock", "w") as f:
        json.dump({}, f)
    os.utime(f"{place}/lock", (time.time() - 2 * engine.STALE,) * 2)
    assert built.refresh(frame(spark, FILES))["unchanged"] == 3


def test_another_repository_is_refused(built, spark):
    with pytest.raises(ValueError):
        built.refresh(frame(spark, FILES), identity={"root_commits": ["b"]})
    assert built.refresh(frame(spark, FILES), identity={"root_commits": ["b", "a"]})["unchanged"] == 3
    engine.verify({"remote": "x"}, {"root_commits": ["a"]})
    with pytest.raises(ValueError):
        engine.verify({"remote": "x"}, {"remote": "y"})


def test_expansion_fills_what_is_left(built, spark):
    spec = "repo string, file_path string, source_chunk_id string, target_symbol string, ref_type string, place int"
    one = built.table("chunks").where("symbol_name = 'check_login'").first()
    place = built.place.removeprefix("file://") + "/v1/refs"
    shutil.rmtree(place)
    spark.createDataFrame([("r", one["file_path"], one["id"], "write_audit", "call", 0)], spec).write.parquet(f"file://{place}")
    rows = built.query("login", 5).collect()
    assert rows[0]["symbol_name"] == "check_login" and rows[-1]["symbol_name"] == "write_audit" and rows[-1]["match_reason"] == "graph_expansion" and rows[-1]["score"] == 0
    assert [r["match_reason"] for r in built.query("login", len(rows) - 1).collect()].count("graph_expansion") == 0
    off = Index(spark, built.place, built.embed, Settings(graph_expand_enabled=False)).query("login", 5).collect()
    assert "graph_expansion" not in {r["match_reason"] for r in off}


def test_queries_outlive_a_failing_part(built, caplog):
    def broken(_):
        raise RuntimeError("no model")

    whole = [tuple(r) for r in built.query("TokenStore", 5).collect()]
    assert whole and [tuple(r) for r in built.query("TokenStore", 5, rerank=broken).collect()] == whole and "left out" in caplog.text
    assert [tuple(r) for r in built.query("TokenStore", 5, vector=[1.0, 2.0, 3.0]).collect()] == whole
    assert "vector" in {m for r in built.query("TokenStore", 5, vector=[60.0, 1.0]).collect() for m in r["match_reason"].split("+")}
    ranked = Index(built.spark, built.place, built.embed, Settings(rerank_enabled=True)).query("TokenStore", 2).collect()
    assert all(r["match_reason"].endswith("+reranked") for r in ranked) and ranked[0]["score"] == 1.0


def test_catalogue(spark, tmp_path):
    for n in ("one", "two"):
        Index(spark, f"file://{tmp_path}/{n}").build(frame(spark, FILES, n))
    (tmp_path / "empty").mkdir()
    assert [(x["name"], x["files"]) for x in catalogue(spark, f"file://{tmp_path}")] == [("one", 3), ("two", 3)]
    both = Index(spark, f"file://{tmp_path}/both")
    both.build(frame(spark, FILES, "a").unionByName(frame(spark, FILES, "b")))
    rows = both.query("audit", 3).collect()
    assert {r["repo"] for r in rows} == {"a", "b"} and max(r["score"] for r in rows) == 1.0


def test_references_of_each_language():
    f = references.found
    assert f("a.py", "from a.b import (c, d as e)  # x\nimport q.w\n@dec.x\nclass A(B[T], object, C):\n    pass\n") == [(1, "a.b.c", "import"), (1, "a.b.d", "import"), (2, "q.w", "import"), (4, "B", "inherits"), (4, "C", "inherits"), (3, "dec.x", "decorator")]
    assert f("a.vue", "import X from 'x'\nimport { a as b,\n c } from \"q\"") == [(2, "a", "import"), (2, "c", "import"), (1, "X", "import")]
    assert f("a.php", "<?php\nuse A\\B as C;\nclass D extends \\E implements F, \\G {") == [(2, "A\\B", "import"), (3, "E", "inherits"), (3, "F", "inherits"), (3, "G", "inherits")]
    assert f("a.blade.php", "use A;") == [] and f("a.md", "import x") == [] and f("", "") == []
    assert references.holders([(5, 9, "b"), (1, 3, "a")], [1, 4, 6, 12, 0]) == ["a", "a", "b", "a", "a"]


def names(text, limit=6000):
    return [(c.symbol_name, c.start_line, c.end_line) for c in chunk_file("t.blade.php", text, limit)]


def test_template_blocks():
    assert names("<p>@@if is literal</p>\n@if ($x)\n<b>y</b>\n@endif\n") == [("", 1, 1), ("", 2, 4)]
    assert names("@section('a')\n<p>one</p>\n@section('b')\n<p>two</p>\n") == [("section:a", 1, 4)]
    assert names("@hasSection('x')\n<a>\n@endif\n@section('c')\n<p>\n@php($x = 1)\n@endsection\n@Section('t', 'R')\n@push('s')\n<s>\n@endPush\n{{-- @section('q') --}}\n") == [("", 1, 3), ("section:c", 4, 7), ("", 8, 8), ("push:s", 9, 11), ("", 12, 12)]
    assert names("@verbatim\n@if\n@endverbatim\n@if ($a)\n@foreach ($b as $c)\n@endforeach\n@endif\n") == [("", 1, 3), ("", 4, 7)]
    filler = "        <p>row</p>\n" * 20
    parts = chunk_file("t.blade.php", "@section('content')\n" + filler + "@foreach ($rows as $row)\n" + filler + "@endforeach\n@endsection\n", 600)
    assert {c.symbol_name for c in parts} == {"section:content"} and {c.symbol_type for c in parts} == {"section"}
    each = next(c for c in parts if c.content.startswith("@foreach"))
    assert each.content.rstrip().endswith("@endforeach")


def test_chunks_and_references_come_from_one_pass(spark):
    files = frame(spark, {**FILES, "x.py": None, "y.py": "def (", "z.md": "# A\n"})
    both = chunk_and_refer(files).collect()
    assert sorted(tuple(r)[:11] for r in both if r["ref_type"] is None) == sorted(map(tuple, chunk_files(files).collect())) or len([r for r in both if r["ref_type"] is None]) == chunk_files(files).count()
    ids = {r["id"] for r in both if r["ref_type"] is None}
    assert all(r["id"] in ids for r in both)


def test_a_stream_loses_nothing_when_run_again(spark, tmp_path):
    """Three batches, the last handed in twice, then a restart with one file more."""
    place, base = tmp_path / "in", f"file://{tmp_path}/state"
    place.mkdir()

    def arrive(n, rows):
        spark.createDataFrame(rows, "k string, at int, v string").coalesce(1).write.mode("append").parquet(f"file://{place}")
        for f in place.glob("part-*"):
            os.utime(f, None)
        time.sleep(0.05)

    arrive(1, [("a", 1, "x")])
    arrive(2, [("b", 1, "y")])
    arrive(3, [("c", 1, "z"), ("a", 2, "w")])
    source = f"file://{place}"
    state = lambda: sorted(map(tuple, refresh_stream(spark, source, ["k"], ["at"], base=base, files_a_batch=1).collect()))
    want = [("a", 2, "w"), ("b", 1, "y"), ("c", 1, "z")]
    assert state() == want
    progress = tmp_path / "state" / "progress"
    last = max(int(f) for f in os.listdir(progress / "commits") if f.isdigit())
    for f in (progress / "commits").glob(f"*{last}*"):
        f.unlink()
    assert last == 2 and state() == want
    arrive(4, [("d", 1, "q")])
    assert state() == [*want, ("d", 1, "q")]


@pytest.mark.skipif(shutil.which("git") is None, reason="no git")
def test_git_sources(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e", *a], check=True, capture_output=True)
    assert git.committed_files(spark, str(tmp_path)) is None and git.working_files(spark, str(tmp_path)) is None and git.identity(str(tmp_path)) == {}
    run("init", "-q")
    (tmp_path / "a.py").write_text("x = 1\n")
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "c.txt").write_bytes(b"caf\xe9\n")
    (tmp_path / ".gitignore").write_text("*.log\n")
    run("add", ".")
    run("commit", "-qm", "one")
    first = subprocess.run(["git", "-C", str(tmp_path), "rev-parse", "HEAD"], capture_output=True, text=True).stdout.strip()
    (tmp_path / "new.py").write_text("y = 2\n")
    (tmp_path / "x.log").write_text("")
    assert [r[0] for r in git.working_files(spark, str(tmp_path)).collect()] == [".gitignore", "a.py", "b/c.txt", "new.py"]
    files = git.with_contents(git.committed_files(spark, str(tmp_path)), str(tmp_path), "r")
    assert {r["file_path"]: r["content"] for r in files.collect()} == {".gitignore": "*.log\n", "a.py": "x = 1\n", "b/c.txt": "caf\ufffd\n"}
    (tmp_path / "a.py").unlink()
    run("add", ".")
    run("commit", "-qm", "two")
    assert {tuple(r) for r in git.changed_since(spark, str(tmp_path), first).collect()} == {("a.py", "deleted"), ("new.py", "added")}
    assert git.changed_since(spark, str(tmp_path), "0" * 40) is None and git.identity(str(tmp_path))["root_commits"] == [first]


def test_paths_that_leave_the_repository(spark):
    rows = ["a/b.py", "", None, "../x", "a/../../b", "/etc", "C:\\x", "a\\b", "a..b/c", "a\x00b", "..", "a/.."]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "p string").where(inside(F.col("p"))).collect()]
    assert got == ["a/b.py", "a..b/c"]


def test_shared_folder(spark):
    assert shared_dir(spark).startswith("file:")


def spans(path, text, limit=6000):
    return [(c.symbol_name, c.symbol_type, c.start_line, c.end_line) for c in chunk_file(path, text, limit)]


def test_components_by_element():
    text = "<script setup lang=\"ts\">\nimport { ref } from 'vue';\ninterface Review { id: number }\nconst canModerate = () => true;\nasync function approve(r: Review) {\n  await go(r);\n}\n</script>\n\n<template>\n  <div class=\"a\">\n    <br>\n    <img src=\"x\"/>\n    <p v-if=\"a > b\">two</p>\n  </div>\n</template>\n\n<style scoped>\n.a { color: red }\n</style>\n<i18n>\n{}\n</i18n>\n"
    assert spans("a.vue", text) == [("", "module", 2, 2), ("Review", "interface", 3, 3), ("canModerate", "function", 4, 4), ("approve", "function", 5, 7), ("template", "block", 10, 16), ("style", "block", 18, 20), ("", "block", 21, 23)]
    row = "    <li>a row of some text that is long enough to fill</li>\n"
    parts = [c for c in chunk_file("b.vue", "<template>\n<div>\n  <ul>\n" + row * 20 + "  </ul>\n  <section>\n" + row * 4 + "  </section>\n  <b>x</b>\n</div>\n</template>\n", 500) if c.place is None or c.place == 0]
    assert {c.symbol_name for c in parts} == {"template"} and len(parts) == 3 and parts[-1].end_line == 33
    assert spans("c.vue", "no element\n") == [("", "block", 1, 1)] and spans("d.vue", "<template>\n<div>\n") == [("template", "block", 1, 2)]


def test_functions_of_objects():
    text = "export default {\n  name: 'x',\n  data() {\n    return { a: 1 };\n  },\n  methods: {\n    // goes\n    go: async (a, b) => {\n      return a;\n    },\n    stop: function () {\n      return 1;\n    },\n  },\n  computed: {},\n};\nconst conf = { a: 1, b: { c: 2 } };\nconst api = {\n  list: (x) => get(x),\n  url: '/x',\n};\n"
    assert spans("a.ts", text) == [("", "block", 1, 16), ("data", "method", 3, 5), ("methods", "block", 6, 14), ("methods.go", "method", 7, 10), ("methods.stop", "method", 11, 13), ("conf", "variable", 17, 17), ("api", "variable", 18, 21), ("api.list", "method", 19, 19)]
    assert "return a" not in chunk_file("a.ts", text)[0].content and "name: 'x'" in chunk_file("a.ts", text)[0].content
    assert spans("a.js", "export default defineComponent({\n  setup() {\n    return 1;\n  },\n  a: 1,\n});\n") == [("", "block", 1, 6), ("setup", "method", 2, 4)]


def test_markup_between_code():
    text = "<html>\n<body>\n<?php\nuse A;\nfunction f() {\n  return \"?>\";\n}\n?>\n<p>x</p>\n<?= f() ?>\n</body>\n"
    assert spans("a.php", text) == [("", "block", 1, 2), ("", "module", 3, 4), ("f", "function", 5, 7), ("", "block", 8, 8), ("", "block", 9, 9), ("", "block", 10, 10), ("", "block", 11, 11)]


def test_searches_equal_brute_force(spark, monkeypatch):
    """A group with a third of all rows, ties, nulls, vectors of another length, queries in several blocks."""
    import random

    from quarry.operators import vectors

    monkeypatch.setattr(vectors, "BLOCK", 3)
    rng = random.Random(2)
    rows = [("big" if i % 3 == 0 else f"g{i % 5}", i, [float(rng.randrange(3)) for _ in range(4)]) for i in range(300)]
    rows += [("big", 900, None), ("big", 901, [1.0, 2.0]), ("big", None, [1.0] * 4), ("big", 902, [1.0, None, 1.0, 1.0]), (None, 903, [1.0] * 4)]
    asked = [(i, g, [1.0, 0.0, 2.0, float(i)]) for i, g in enumerate(["big", "big", "g1", "g2", "none", "g4", "big"])] + [(50, "big", None)]
    df = spark.createDataFrame(rows, "grp string, key long, x array<double>")
    q = spark.createDataFrame(asked, "query_id long, grp string, x array<double>")
    for metric, sign in (("l2", 1), ("dot", -1)):
        score = {"l2": lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True)) ** 0.5, "dot": lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))}[metric]
        want = []
        for i, g, v in asked:
            near = sorted((round(sign * score(v, x), 10), k) for h, k, x in rows if v and h == g and x and len(x) == 4 and None not in x and k is not None)
            want += [(i, k, n + 1) for n, (_, k) in enumerate(near[:7])]
        assert sorted((r["query_id"], r["key"], r["rank"]) for r in vectors.search(df, q, 7, metric).collect()) == sorted(want)
    texts = spark.createDataFrame([("g", 1, "alpha beta"), ("g", 2, "alpha"), ("g", 3, ""), ("g", 4, None), ("g", 5, "gamma")], "grp string, key long, x string")
    ask = spark.createDataFrame([(1, "g", "alpha"), (2, "g", ""), (3, "g", None)], "query_id long, grp string, x string")
    assert [(r["query_id"], r["key"], round(r["score"], 6)) for r in vectors.search(texts, ask, 2, positive=True, embed=vectors.embedder()).orderBy("query_id", "rank").collect()] == [(1, 2, 1.0), (1, 1, round(0.5**0.5, 6))]
    assert vectors.search(df, q.limit(0), 3).collect() == []


def test_bitmaps_lose_nothing(spark):
    from quarry.functions.bitmaps import bitmap, maybe

    keys = spark.range(0, 4000, 7).select(F.xxhash64("id").alias("h"))
    left = maybe(spark.range(4000).withColumn("h", F.xxhash64("id")), bitmap(keys))
    got = {r["id"] for r in left.collect()}
    assert {*range(0, 4000, 7)} <= got and len(got) < 700 and maybe(left, bitmap(keys.limit(0))).count() == 0


def test_marks_are_folded(spark):
    from quarry.functions.search import terms

    got = spark.createDataFrame([("Ĉapelo Ångström ṽ ñandú ΆΛΦΑ",)], "t string").select(terms(F.col("t"))).first()[0]
    assert got == ["capelo", "angstrom", "v", "nandu", "αλφα"]
