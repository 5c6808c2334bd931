"""Exact nearest neighbours and the bag-of-words embedder."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.search import bucket
from quarry.sources.session import map_arrow

#: Queries that travel to the executors at a time.
BLOCK = 20_000


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def nearest(vectors: DataFrame, key: str, vector: str, query: list[float], k: int, metric: str = "l2") -> DataFrame:
    """(key, distance, rank): the k rows nearest to one query vector, which travels as a literal.

    Vectors of another length, null ones and null keys are left out. Each task keeps its k best, so no more than k
    rows a task are shuffled. Cosine distance is 1 - cosine."""
    q = F.array(*[F.lit(float(x)) for x in query])
    d = l2(F.col(vector), q) if metric == "l2" else 1 - cosine(F.col(vector), q)
    rows = vectors.where((F.size(vector) == len(query)) & F.col(key).isNotNull()).select(F.col(key).alias("key"), d.alias("distance"))
    best = rows.orderBy(F.round("distance", 10), "key").limit(k)
    place = F.transform(F.array_sort(F.collect_list(F.struct(F.round("distance", 10).alias("r"), "key", "distance"))), lambda s, i: F.struct(s["key"].alias("key"), s["distance"].alias("distance"), (i + 1).cast("long").alias("rank")))
    return best.agg(place.alias("a")).select(F.inline("a"))


def bag_of_words(df: DataFrame, key: str, text: str, dim: int = 64) -> DataFrame:
    """(key, bucket, value): the non-zero entries of each text's normalised bag-of-words vector; empty texts have none."""
    tokens = df.select(F.col(key).alias("key"), F.explode(F.filter(F.split(F.lower(F.col(text)), r"\s+"), lambda w: w != "")).alias("w"))
    counts = tokens.groupBy("key", bucket(F.col("w"), dim).alias("bucket")).agg(F.count("*").alias("n"))
    norm = counts.groupBy("key").agg(F.sqrt(F.sum(F.col("n") * F.col("n")).cast("double")).alias("norm"))
    return counts.join(norm, "key").select("key", "bucket", (F.col("n") / F.col("norm")).alias("value"))


class Buckets(dict):
    """The bag-of-words bucket of a word, kept per worker; at most a million words are kept."""

    def __init__(self, dim: int) -> None:
        self.dim = dim

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        b = self[word] = int.from_bytes(hashlib.md5(word).digest()[:4], "little") % self.dim
        return b


def embedder(dim: int = 64) -> Callable[[list], np.ndarray]:
    """Texts as rows of a matrix: the normalised bag-of-words vector of each; zeros for null and empty ones."""
    of = Buckets(dim)

    def run(texts: list) -> np.ndarray:
        # bytes are split at " \t\n\x0b\f\r", as the pattern for white space has it in queries
        words = [t.lower().encode("utf-8", "surrogatepass").split() if t else [] for t in texts]
        buckets = np.array(list(map(of.__getitem__, chain.from_iterable(words))), dtype=np.int64)
        at = np.repeat(np.arange(len(texts)) * dim, np.array(list(map(len, words)), dtype=np.int64))
        out = np.bincount(at + buckets, minlength=len(texts) * dim).reshape(-1, dim).astype(np.float64)
        n = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return np.divide(out, n, out=out, where=n > 0)

    return run


def search(rows: DataFrame, queries: DataFrame, k: int, metric: str = "dot", positive: bool = False, embed: Callable[[list], np.ndarray] | None = None) -> DataFrame:
    """(query_id, key, score, rank): the k best rows of its group for every query.

    rows has grp, key and `x`, a vector, or with `embed` what that makes a vector of; queries has query_id, grp and x
    likewise. metric: dot, cosine or l2 (score is then the distance, less is better). Ties go by key; with `positive` only
    scores above 0 count. Vectors of another length than the query's, null ones and null keys are left out.

    Queries travel in blocks of BLOCK; each batch of rows is multiplied with those of its groups. A first pass hands on a few of the
    best scores of each task, which give a bound that the k-th best of a query reaches; a second hands on the rows within the
    bound, so about k rows a query are shuffled, however many tasks there are, and rows of a group of any size stay where they
    are read."""
    parts = -(-queries.count() // BLOCK)
    kind, ident = rows.schema["key"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    rows, context = rows.select("grp", "key", "x"), rows.sparkSession.sparkContext
    found = None
    for part in range(parts):
        block: dict = {}
        mine = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part).select("query_id", "grp", "x").where("x is not null").collect()
        made = embed([r["x"] for r in mine]) if embed else [np.array(r["x"], dtype=np.float64) for r in mine]
        for i, (r, v) in enumerate(zip(mine, made, strict=True)):
            block.setdefault((r["grp"], len(v)), []).append((i, v))
        block = {g: (np.array([i for i, _ in v]), np.stack([x for _, x in v])) for g, v in block.items()}
        shared = context.broadcast(block)
        best = map_arrow(rows, _scores_of_tasks(shared, k, metric, positive, embed), "i int, s array<float>").groupBy("i").agg(F.collect_list("s").alias("s"))
        bounds = np.full(len(mine), np.inf)
        for r in map_arrow(best, _bounds(k), "i int, bound double").collect():
            bounds[r["i"]] = r["bound"]
        sent = context.broadcast((bounds, [r["query_id"] for r in mine]))
        one = map_arrow(rows, _within(shared, sent, k, metric, positive, embed, (_ARROW[ident], _ARROW[kind])), f"query_id {ident}, key {kind}, score double")
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = queries.select("query_id").limit(0).withColumn("key", F.lit(None).cast(kind)).withColumn("score", F.lit(0.0))
    w = Window.partitionBy("query_id").orderBy(F.round(_sign(metric) * F.col("score"), 10), "key")
    return found.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def _sign(metric: str) -> float:
    """What makes less of a score better."""
    return 1.0 if metric == "l2" else -1.0


def _scored(batch: pa.RecordBatch, block: dict, metric: str, embed: Callable[[list], np.ndarray] | None) -> Iterator[tuple]:
    """(group, keys, queries, scores) of a batch, scores with one row a query and one column a key, less being better."""
    groups, keys, xs = (c.to_pylist() for c in batch.columns)
    vs = embed(xs) if embed else [None if x is None or None in x else np.array(x, dtype=np.float64) for x in xs]
    by: dict = {}
    for i, (g, key, v) in enumerate(zip(groups, keys, vs, strict=True)):
        if v is not None and key is not None and (g, len(v)) in block:
            by.setdefault((g, len(v)), []).append(i)
    for g, members in by.items():
        yield g, [keys[i] for i in members], block[g][0], _sign(metric) * _scores(block[g][1], np.stack([vs[i] for i in members]), metric)


def _places(k: int) -> np.ndarray:
    """The places of a task's best rows whose scores are handed on: 1, 2, 3, 4, 6, 8, 12 ... k."""
    return np.unique([min(k, x) for j in range(k.bit_length() + 1) for x in (1 << j, 3 << j)])


def _scores_of_tasks(shared: Broadcast, k: int, metric: str, positive: bool, embed: Callable[[list], np.ndarray] | None):
    """For each query the scores of the rows of a task at _places, rounded towards the worse."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict = {}
        for batch in batches:
            for g, _, queried, s in _scored(batch, shared.value, metric, embed):
                r = np.where(np.isnan(s) | (s >= 0) & positive, np.inf, np.round(s, 10))
                r = np.concatenate([least.get(g, np.full((len(queried), k), np.inf)), r], axis=1)
                least[g] = np.partition(r, k - 1, axis=1)[:, :k]
        for g, r in least.items():
            r = np.sort(r, axis=1)[:, _places(k) - 1]
            with np.errstate(over="ignore"):
                r = np.nextafter((r + 1e-9).astype(np.float32), np.float32(np.inf))
            some = np.isfinite(r[:, 0])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(some.sum() + 1) * r.shape[1], pa.int32()), pa.array(r[some].ravel(), pa.float32()))
            yield pa.RecordBatch.from_arrays([pa.array(shared.value[g][0][some], pa.int32()), lists], names=["i", "s"])

    return run


def _bounds(k: int):
    """The least score that k rows are known to reach, from the lists of all tasks; none where fewer are known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        more = np.diff(_places(k), prepend=0)
        for batch in batches:
            bounds = []
            for lists in batch.column(1).to_pylist():
                s = np.array(lists, dtype=np.float64)
                order = np.argsort(s, axis=None)
                at = np.searchsorted(np.cumsum(np.tile(more, len(s))[order]), k)
                bounds.append(float(s.ravel()[order[at]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bounds, pa.float64())], names=["i", "bound"])

    return run


def _within(shared: Broadcast, sent: Broadcast, k: int, metric: str, positive: bool, embed: Callable[[list], np.ndarray] | None, types: tuple):
    """The rows of a batch within the bound of a query, at most k."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, names_of = sent.value
        for batch in batches:
            ids, out, scores = [], [], []
            for _, keys, queried, s in _scored(batch, shared.value, metric, embed):
                r = np.round(s, 10)
                near = ~(r > bounds[queried][:, None])
                if positive:
                    near &= s < 0
                names = np.argsort(np.argsort(np.array(keys, dtype=object)))
                for j in np.flatnonzero(near.any(axis=1)).tolist():
                    at = np.flatnonzero(near[j])
                    at = at[np.lexsort((names[at], r[j, at]))][:k]
                    ids += [names_of[queried[j]]] * len(at)
                    out += [keys[i] for i in at.tolist()]
                    scores += (_sign(metric) * s[j, at]).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(ids, types[0]), pa.array(out, types[1]), pa.array(scores, pa.float64())], names=["query_id", "key", "score"])

    return run


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def _scores(q: np.ndarray, m: np.ndarray, metric: str) -> np.ndarray:
    """One row a query, one column a row; cosine with a vector of zeros is 0."""
    if metric == "l2":
        return np.stack([np.sqrt(((x - m) ** 2).sum(axis=1)) for x in q])
    if metric == "cosine":
        norm = np.sqrt((q * q).sum(axis=1))[:, None] * np.sqrt((m * m).sum(axis=1))[None]
        return np.divide(q @ m.T, norm, out=np.zeros(norm.shape), where=norm > 0)
    return q @ m.T
