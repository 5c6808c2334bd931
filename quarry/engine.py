"""An index of source files: build, refresh, query, status."""

from __future__ import annotations

import json
import logging
import os
import socket
import time
from collections.abc import Callable
from contextlib import contextmanager
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.search import symbol_candidates, symbol_weight
from quarry.operators import bm25, fusion, graph, index, vectors
from quarry.operators.chunking import CHUNKS_DDL, chunk_and_refer
from quarry.sources.config import Settings
from quarry.sources.session import ship
from quarry.sources.tables import cut

COLUMNS = ["content", "file_path", "symbol_name"]
FULL_TEXT_LIMIT, VECTOR_LIMIT, SYMBOL_LIMIT, SYMBOL_GATE, RERANKED = 30, 90, 5, 0.3, 3
#: Version of the layout on disk; an index of a newer one is refused.
LAYOUT = 2
#: A writer's lock that is older than so many seconds belongs to one that died.
STALE = 3600
TABLES = ["files", "chunks", "symbols", "refs", "postings", "lengths", "vectors"]
log = logging.getLogger(__name__)


class Locked(RuntimeError):
    """Another writer holds the index."""


class Index:
    """Versioned tables under `place`: files, chunks, symbols, refs, postings, lengths, vectors.

    A version is written whole before a pointer of its number names it, and the highest pointer is the one in use; a
    pointer appears by a rename and no older one is touched, so readers never see a half-written or no index, wherever a
    writer stops. What did not change is copied as rows: only added and changed files are parsed, and only chunks whose id
    is new are posted and embedded. `embed` gives a vector column for a text column; without it there is no vector search."""

    def __init__(self, spark: SparkSession, place: str, embed: Callable[[Column], Column] | None = None, settings: Settings | None = None) -> None:
        self.spark, self.place, self.embed, self.settings = spark, place.rstrip("/"), embed, settings or Settings()
        ship(spark)

    # Versions.

    def _path(self, name: str) -> str:
        return f"{self.place}/{name}"

    def _hadoop(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(name))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self) -> list[str]:
        fs, path = self._hadoop("")
        return [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []

    def _read(self, name: str) -> dict:
        fs, path = self._hadoop(name)
        stream = fs.open(path)
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _put(self, name: str, content: dict, overwrite: bool) -> None:
        fs, path = self._hadoop(name)
        out = fs.create(path, overwrite)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()

    def _pointers(self) -> list[int]:
        return sorted(int(n[8:]) for n in self._names() if n.startswith("current.") and n[8:].isdigit())

    def _pointer(self) -> dict | None:
        known = self._pointers()
        if not known:
            return None
        state = self._read(f"current.{known[-1]}")
        if state["layout"] > LAYOUT:
            raise ValueError(f"the index has layout {state['layout']}; this release knows {LAYOUT}")
        return state

    def _publish(self, state: dict) -> None:
        made = f"making.{state['version']}"
        self._put(made, state, True)
        fs, old = self._hadoop(made)
        if not fs.rename(old, self._hadoop(f"current.{state['version']}")[1]):
            raise OSError(f"version {state['version']} of {self.place} could not be named")

    @contextmanager
    def _writing(self):
        """Holds the lock: a file that only one writer can create. One left by a dead writer is taken over after STALE seconds."""
        fs, path = self._hadoop("lock")
        if fs.exists(path) and time.time() - fs.getFileStatus(path).getModificationTime() / 1000 > STALE:
            fs.delete(path, False)
        try:
            self._put("lock", {"host": socket.gethostname(), "pid": os.getpid(), "at": datetime.now(UTC).isoformat()}, False)
        except Exception as e:
            raise Locked(f"{self.place} is being written by another") from e
        try:
            yield
        finally:
            fs.delete(path, False)

    def table(self, name: str) -> DataFrame:
        state = self._pointer()
        if state is None:
            raise FileNotFoundError(f"no index under {self.place}")
        return self._table(name, state["version"])

    def _table(self, name: str, version: int) -> DataFrame:
        read = self.spark.read.schema(f"{CHUNKS_DDL}, branches string") if name == "chunks" else self.spark.read
        return read.parquet(self._path(f"v{version}/{name}"))

    def clean(self, keep: int = 2) -> list[str]:
        """Removes pointers and versions but the last `keep`, and versions that were never named; the names removed."""
        with self._writing():
            known = self._pointers()[-max(1, keep) :]
            gone = [n for n in self._names() if n.startswith(("current.", "making.")) and not (n.startswith("current.") and int(n[8:]) in known)]
            gone += [n for n in self._names() if n[:1] == "v" and n[1:].isdigit() and int(n[1:]) not in known]
            for n in gone:
                fs, path = self._hadoop(n)
                fs.delete(path, True)
        return sorted(gone)

    # Building.

    def _write(self, files: DataFrame, parsed: DataFrame, branch: str, identity: dict, old: dict | None, kept: DataFrame | None) -> None:
        """A new version: what `parsed` (rows of chunk_and_refer) has, and of the old one the rows of the files in `kept` (with their branches)."""
        version = (old["version"] if old else 0) + 1
        at = lambda n: self._path(f"v{version}/{n}")
        keys = ["repo", "file_path"]
        before = lambda n: self._table(n, old["version"])
        mine = lambda n: before(n).join(kept.select(*keys), keys, "left_semi")
        files.write.mode("overwrite").parquet(at("files"))
        chunks = parsed.where("ref_type is null").select(*[x.split()[0] for x in CHUNKS_DDL.split(", ")]).withColumn("branches", F.lit(branch))
        refs = parsed.where("ref_type is not null").select("repo", "file_path", F.col("id").alias("source_chunk_id"), "target_symbol", "ref_type", "place")
        if kept is not None:
            chunks = chunks.unionByName(before("chunks").drop("branches").join(kept.select(*keys, F.col("branches")), keys).select(*chunks.columns))
            refs = refs.unionByName(mine("refs"))
        chunks.write.mode("overwrite").partitionBy("repo").parquet(at("chunks"))
        refs.write.mode("overwrite").parquet(at("refs"))
        made = self._table("chunks", version)
        symbols = made.where("symbol_name <> '' and parent_chunk_id is null").select("repo", "file_path", "symbol_name", F.col("id").alias("chunk_id"), F.lit(None).cast("timestamp").alias("removed_at")).distinct()
        symbols.write.mode("overwrite").parquet(at("symbols"))
        one = made.groupBy("repo", "id").agg(*[F.max(c).alias(c) for c in COLUMNS])
        derived = {
            "postings": (["grp", "key"], lambda d: bm25.postings(d, F.col("repo"), "id", COLUMNS)),
            "lengths": (["grp", "key"], lambda d: bm25.lengths(d, F.col("repo"), "id", COLUMNS)),
        }
        if self.embed:
            derived["vectors"] = (["repo", "chunk_id"], lambda d: d.select("repo", F.col("id").alias("chunk_id"), self.embed(F.col("content")).alias("embedding")))
        ids = cut(one.select("repo", "id"))
        for name, (key, make) in derived.items():
            fresh, carried = one, None
            if old and name in old["tables"]:
                there = before(name)
                known = (before("lengths") if name == "postings" else there).select(F.col(key[0]).alias("repo"), F.col(key[1]).alias("id")).distinct()
                fresh = one.join(known, ["repo", "id"], "left_anti")
                carried = there.join(ids.toDF(*key), key, "left_semi")
            out = make(fresh)
            out = out if carried is None else out.unionByName(carried.select(*out.columns))
            (out.sortWithinPartitions("term") if name == "postings" else out).write.mode("overwrite").parquet(at(name))
        names = ["files", "chunks", "symbols", "refs", *derived]
        self._publish({"layout": LAYOUT, "version": version, "branch": branch, "indexed_at": datetime.now(UTC).isoformat(), "identity": identity, "tables": names})

    def build(self, files: DataFrame, branch: str = "", identity: dict | None = None) -> dict:
        """Indexes files (repo, file_path, content, content_hash) anew. `identity` (root_commits, remote) says whose files they are."""
        with self._writing():
            parsed = cut(chunk_and_refer(files, self.settings.chunk_max_chars))
            self._write(files.drop("content"), parsed, branch, identity or {}, self._pointer(), None) if self._pointer() is None else self._rebuild(files, parsed, branch, identity or {})
        return self.status()

    def _rebuild(self, files: DataFrame, parsed: DataFrame, branch: str, identity: dict) -> None:
        """A build over an index: nothing is carried over."""
        self._write(files.drop("content"), parsed, branch, identity, {"version": self._pointer()["version"], "tables": []}, None)

    def refresh(self, files: DataFrame, branch: str | None = None, identity: dict | None = None, only: DataFrame | None = None) -> dict[str, int]:
        """Brings the index to the given files: only added and changed ones are parsed, unchanged ones gain the branch.

        With `only` (repo, file_path) all other files stay as they are, whether given or not. A file whose content is null
        could not be read: what the index has of it stays. Files of another repository, by root commits or else by
        remote, are refused."""
        keys = ["repo", "file_path"]
        with self._writing():
            state = self._pointer()
            if state is None:
                raise FileNotFoundError(f"no index under {self.place}")
            verify(state.get("identity") or {}, identity or {})
            branch = state["branch"] if branch is None else branch
            stored = self.table("files")
            looked = stored.join(only.select(*keys), keys, "left_semi") if only is not None else stored
            given = files.join(only.select(*keys), keys, "left_semi") if only is not None else files
            actions = index.difference(looked, given, keys, "content_hash").join(given.select(*keys, F.col("content").isNull().alias("unread")), keys, "left")
            actions = cut(actions.select(*keys, F.when(F.coalesce("unread", F.lit(False)) & (F.col("action") != "unchanged"), "failed").otherwise(F.col("action")).alias("action")))
            counts = {r["action"]: r["count"] for r in actions.groupBy("action").count().collect()}
            of = lambda *a: actions.where(F.col("action").isin(*a)).select(*keys)
            parsed = cut(chunk_and_refer(given.join(of("added", "changed"), keys, "left_semi"), self.settings.chunk_max_chars))
            old = self.table("chunks").select(*keys, "branches").distinct().join(of("added", "changed", "deleted"), keys, "left_anti")
            if branch:
                merged = F.array_join(F.array_sort(F.array_union(F.filter(F.split("branches", ","), lambda b: b != ""), F.array(F.lit(branch)))), ",")
                same = of("unchanged").withColumn("_same", F.lit(True))
                old = old.join(same, keys, "left").withColumn("branches", F.when(F.col("_same"), merged).otherwise(F.col("branches"))).drop("_same")
            kept = cut(old.groupBy(*keys).agg(F.max("branches").alias("branches")))
            now = given.drop("content").join(of("added", "changed", "unchanged"), keys, "left_semi")
            columns = now.columns
            rest = stored.join(of("added", "changed", "unchanged", "deleted"), keys, "left_anti").select(*[F.col(c) if c in stored.columns else F.lit(None).alias(c) for c in columns])
            self._write(cut(now.unionByName(rest)), parsed, branch, {**(state.get("identity") or {}), **(identity or {})}, state, kept)
        return {a: counts.get(a, 0) for a in ("added", "changed", "unchanged", "deleted")} | ({"failed": counts["failed"]} if "failed" in counts else {})

    # Queries.

    def _tried(self, what: str, make: Callable[[], DataFrame]) -> DataFrame | None:
        """The rows of a retriever, at most its limit a repository; None, with a warning, if it fails: the others still answer."""
        try:
            return cut(make())
        except Exception:
            log.warning("%s failed and is left out", what, exc_info=True)
            return None

    def query(self, text: str, top_k: int | None = None, branch: str | None = None, repo: str | None = None, vector: list[float] | None = None, rerank: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """The top_k results over one repository or all: repo, chunk_id, file_path, symbol_name, symbol_type, content, score, start_line, end_line, search_quality, match_reason, position.

        Full text, vectors (if there is a query vector) and symbol names (if the text looks like one) are fused per repository;
        where the vectors find nothing the full text decides alone. The 3 top_k best are reranked; chunks one reference away
        from the first five fill what is left of top_k. Over several repositories scores are divided by the best of each. The
        branch filter applies behind the retrievers' limits. A retriever or reranker that fails is left out."""
        top_k = self.settings.top_k if top_k is None else top_k
        if not 1 <= top_k <= 100:
            raise ValueError("top_k must be from 1 to 100")
        spark = self.spark
        state = self._pointer()
        if state is None:
            raise FileNotFoundError(f"no index under {self.place}")
        branch = state["branch"] if branch is None else branch
        of = lambda n, c="repo": self._table(n, state["version"]).where(F.col(c) == repo) if repo else self._table(n, state["version"])
        chunks = of("chunks")
        allowed = index.on_branch(chunks, "branches", branch) if branch else chunks
        known = allowed.groupBy(F.col("repo").alias("query_id"), F.col("id").alias("chunk_id")).agg(F.max("search_quality").alias("search_quality"))
        asked = of("lengths", "grp").select("grp").distinct().select(F.col("grp").alias("query_id"), "grp", F.lit(text).alias("query_text"))
        gate = spark.range(1).select(symbol_weight(F.lit(text)).alias("w"), symbol_candidates(F.lit(text)).alias("c")).first()
        names = [n.lower() for n in gate["c"]] if gate["w"] >= SYMBOL_GATE - 1e-9 else []

        def near() -> DataFrame:
            q = F.array(*[F.lit(float(x)) for x in vector])
            d = of("vectors").where(F.size("embedding") == len(vector)).select(F.col("repo").alias("query_id"), "chunk_id", vectors.l2(F.col("embedding"), q).alias("d"))
            return fusion.list_ranks(d, ["query_id"], "chunk_id", F.col("d")).where(F.col("rank") <= VECTOR_LIMIT).join(known, ["query_id", "chunk_id"])

        def named() -> DataFrame:
            rows = chunks.where(F.lower("symbol_name").isin(names)).select(F.col("repo").alias("query_id"), F.col("id").alias("chunk_id"), F.lower("symbol_name").alias("n")).distinct()
            rows = fusion.list_ranks(rows, ["query_id", "n"], "chunk_id", F.lit(0)).where(F.col("rank") <= SYMBOL_LIMIT)
            return rows.join(known, ["query_id", "chunk_id"]).select("query_id", "chunk_id", "rank", "search_quality")

        none = known.limit(0).withColumn("rank", F.lit(0)).withColumn("score", F.lit(0.0))
        full = self._tried("full text", lambda: bm25.search(of("postings", "grp"), of("lengths", "grp"), asked, FULL_TEXT_LIMIT).withColumnRenamed("key", "chunk_id").join(known, ["query_id", "chunk_id"]))
        full = none if full is None else full
        symbol = (self._tried("symbol search", named) if names else None) or none.drop("score")
        vector_rows = self._tried("vector search", near) if vector is not None and self.embed and "vectors" in state["tables"] else None
        if vector_rows is not None and not vector_rows.isEmpty():
            fused = fusion.reciprocal(full, vector_rows, symbol)
        else:
            fused = fusion.full_text_only(full, symbol)
        fused = cut(fused)
        placed = fusion.top(fused, F.lit(RERANKED * top_k))
        if rerank is not None or self.settings.rerank_enabled:
            better = self._tried("reranking", lambda: (rerank or fusion.rerank_by_place)(placed))
            placed = placed if better is None else better
        placed = fusion.top(placed.drop("position"), F.lit(max(top_k, graph.SEEDS)))
        if self.settings.graph_expand_enabled:
            placed = self._filled(cut(placed), fused, of("refs"), of("symbols"), chunks, known, top_k)
        results = placed.where(F.col("position") <= top_k).drop("position").withColumn("all", F.lit(0))
        if repo is None:
            results = fusion.normalised(results, "query_id")
        results = fusion.top(results, F.lit(top_k), "all")
        shown = chunks.groupBy(F.col("repo").alias("query_id"), F.col("id").alias("chunk_id")).agg(*[F.max(c).alias(c) for c in ("file_path", "symbol_name", "symbol_type", "content", "start_line", "end_line", "search_quality")])
        return results.join(shown, ["query_id", "chunk_id"]).select(
            F.col("query_id").alias("repo"), "chunk_id", "file_path", "symbol_name", "symbol_type", "content", F.round("score", 4).alias("score"), "start_line", "end_line", "search_quality",
            F.col("reason").alias("match_reason"), "position",
        ).orderBy("position")

    def _filled(self, placed: DataFrame, fused: DataFrame, refs: DataFrame, symbols: DataFrame, chunks: DataFrame, known: DataFrame, top_k: int) -> DataFrame:
        """placed and, behind it, the chunks its first five refer to, as far as top_k reaches."""
        seeds = placed.where(F.col("position") <= graph.SEEDS).select("query_id", "chunk_id", "position")
        more = self._tried("graph expansion", lambda: graph.expand(seeds, fused.select("query_id", "chunk_id"), refs, symbols, chunks).join(known.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_semi"))
        return placed if more is None else fusion.fill(placed, more, F.lit(top_k))

    def status(self) -> dict:
        """Counts and state of the version in use: one pass over its chunks, one over its files."""
        state = self._pointer() or {}
        q = lambda x: F.count(F.when(F.col("search_quality") == x, 1)).alias(x)
        row = self.table("chunks").groupBy("id").agg(F.max("search_quality").alias("search_quality"), F.max("file_path").alias("file_path")).agg(F.count("*").alias("chunks"), q("ast"), q("regex"), q("text_fallback")).first().asDict()
        paths = self.table("chunks").groupBy("repo", "file_path").agg(F.max("search_quality").alias("search_quality")).groupBy("search_quality").count().collect()
        vectors_n = self.table("vectors").count() if "vectors" in state.get("tables", []) else 0
        return {
            **state, **row, "files": self.table("files").count(), "files_by_quality": {r[0]: r[1] for r in paths}, "refs": self.table("refs").count(), "symbols": self.table("symbols").count(), "vectors": vectors_n,
            "coverage": round(vectors_n / row["chunks"], 4) if row["chunks"] else 0.0,
        }


def verify(stored: dict, given: dict) -> None:
    """Raises if both sides tell whose files they are and it is not the same repository: by root commits, else by remote."""
    for what, same in (("root_commits", lambda a, b: bool(set(a) & set(b))), ("remote", lambda a, b: a == b)):
        if stored.get(what) and given.get(what):
            if not same(stored[what], given[what]):
                raise ValueError(f"the index belongs to another repository ({what} differ)")
            return


def catalogue(spark: SparkSession, base: str) -> list[dict]:
    """The status of every index directly under `base`, by name; folders without an index are left out."""
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(x.getPath().getName() for x in fs.listStatus(path) if x.isDirectory()) if fs.exists(path) else []
    found = [(n, Index(spark, f"{base.rstrip('/')}/{n}")) for n in names]
    return [{"name": n, **i.status()} for n, i in found if i._pointers()]
