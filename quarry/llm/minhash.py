"""b-bit MinHash: signatures, band candidates and collision-corrected similarity."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.bitmaps import bitmap, maybe
from quarry.sources.session import map_arrow
from quarry.sources.tables import cut

#: Bits kept of each minimum. Two unequal minima agree in them with probability 2**-BITS.
BITS = 2
ROWS, BANDS = 6, 26
HASHES = ROWS * BANDS
WORDS = -(-HASHES * BITS // 64)
#: Pairs whose estimate is below this are not verified: five standard deviations below 0.8.
LEAST_ESTIMATE = 0.6
#: Documents of a band that meet in one cell; a band with more is cut into blocks, every two of which meet in a cell of their own.
BLOCK = 1024
_WORD = re.compile(r"[a-z0-9_]+")
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3 (public domain)."""
    x = x ^ (x >> np.uint64(33))
    x = x * _M1
    x = x ^ (x >> np.uint64(33))
    x = x * _M2
    return x ^ (x >> np.uint64(33))


def _multipliers() -> np.ndarray:
    state = np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix(state) | np.uint64(1)


_A = _multipliers()
_A32, _B32 = (_A >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (mix(_A) >> np.uint64(32)).astype(np.uint32)


class WordHashes(dict):
    """64-bit hashes of words, kept per worker; at most a million words are kept."""

    def __missing__(self, word: str) -> int:
        h = self[word] = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return h

    def of(self, words: list[str]) -> np.ndarray:
        if len(self) > 1_000_000:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_HASHES = WordHashes()


def multiset_elements(words: list[str]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of (word, occurrence): sets of these have the similarity of the multisets."""
    h = np.sort(_HASHES.of(words))
    if not len(h):
        return h
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    nth = np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))
    return np.sort(mix(h + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def set_elements(words: list[str], shingle: int = 1) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the words, or of runs of `shingle` words (fewer words are one run)."""
    h = _HASHES.of(words)
    k = min(shingle, len(h))
    x = h[: len(h) - k + 1]
    for i in range(1, k):
        x = mix(x * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    return np.unique(x)


def signatures(elements: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed, bands) of non-empty element sets laid end to end: uint64[docs, WORDS] and uint64[docs, BANDS].

    Each hash is a multiply-add over the element's upper half; the minima are mixed before bits are taken, as the
    low bits of a multiply-add are not random."""
    x = (elements >> np.uint64(32)).astype(np.uint32) ^ elements.astype(np.uint32)
    minima = np.empty((HASHES, len(starts)), dtype=np.uint64)
    for i in range(HASHES):
        minima[i] = np.minimum.reduceat(x * _A32[i] + _B32[i], starts)
    mixed = mix(minima + _A[:, None])
    packed = np.zeros((WORDS, len(starts)), dtype=np.uint64)
    per = 64 // BITS
    for i in range(HASHES):
        packed[i // per] |= (mixed[i] & np.uint64((1 << BITS) - 1)) << np.uint64(i % per * BITS)
    bands = np.zeros((BANDS, len(starts)), dtype=np.uint64)
    for b in range(BANDS):
        h = np.full(len(starts), b + 1, dtype=np.uint64)
        for i in range(b * ROWS, (b + 1) * ROWS):
            h = mix(h ^ mixed[i])
        bands[b] = h
    return packed.T, bands.T


SIGNED = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("h", T.LongType()), T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType()), T.StructField("n", T.IntegerType()),
    T.StructField("packed", T.ArrayType(T.LongType())), T.StructField("bands", T.ArrayType(T.LongType())),
])


def _lists(a: np.ndarray) -> pa.Array:
    flat = np.ascontiguousarray(a).view(np.int64).reshape(-1)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, a.shape[1], dtype=np.int32)), pa.array(flat))


def items(words: list[str], shingle: int) -> list[str]:
    return words if shingle == 1 else [" ".join(words[j : j + shingle]) for j in range(max(1, len(words) - shingle + 1))]


def exact(a: str, b: str, multiset: bool = True, shingle: int = 1) -> float:
    """Common elements divided by all elements of two texts, counted as multisets or sets; 0 where there are none."""
    x, y = (Counter(items(_WORD.findall(t.lower()), shingle)) for t in (a, b))
    if not multiset:
        x, y = Counter(x.keys()), Counter(y.keys())
    common = sum((x & y).values())
    every = x.total() + y.total() - common
    return common / every if every else 0.0


def signed(least: int, multiset: bool = True, shingle: int = 1):
    """For mapInArrow over (id, h, text): rows of SIGNED for texts with at least `least` words; h, a hash of the text, is handed on.

    Elements are the words as a multiset or a set, or the shingles as a set; d1, d2 are a 128-bit digest of them
    (equal sets, equal digest), n is their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes, sets = [], [], []
            for i, h, t in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if t is None or i is None:
                    continue
                words = _WORD.findall(t.lower())
                if len(words) < least:
                    continue
                e = multiset_elements(words) if multiset and shingle == 1 else set_elements(words, shingle)
                if len(e):
                    ids.append(i)
                    hashes.append(h)
                    sets.append(e)
            if not ids:
                continue
            sizes = np.array([len(e) for e in sets])
            starts = np.concatenate(([0], np.cumsum(sizes)))
            elements = np.concatenate(sets)
            packed, bands = signatures(elements, starts[:-1])
            d1 = np.add.reduceat(mix(elements), starts[:-1])
            d2 = np.bitwise_xor.reduceat(mix(elements + np.uint64(0x5851F42D4C957F2D)), starts[:-1])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.string()), pa.array(hashes, pa.int64()), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.array(sizes.astype(np.int32)), _lists(packed), _lists(bands),
                ],
                names=[f.name for f in SIGNED],
            )

    return run


def estimate(a: Column, b: Column) -> Column:
    """The collision-corrected similarity of two packed signatures (b = 2): the share of equal minima, less chance."""
    low = F.lit(0x5555555555555555).cast("long")
    unequal = F.aggregate(
        F.zip_with(a, b, lambda x, y: F.bit_count((x.bitwiseXOR(y)).bitwiseOR(F.shiftrightunsigned(x.bitwiseXOR(y), 1)).bitwiseAND(low))), F.lit(0), lambda s, x: s + x
    )
    chance = 2.0**-BITS
    return ((1 - unequal / HASHES) - chance) / (1 - chance)


def cells(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """rows with the cells (i, j) they meet others in; rows has band and d1, sizes has the number `k` of rows of each band that counts.

    A band of more than BLOCK documents is cut into blocks by hash; each document goes to a cell for every two blocks with
    its own among them, so no task holds more than the pairs of two blocks at a time."""
    e = rows.join(sizes.select("band", F.ceil(F.col("k") / BLOCK).cast("int").alias("s")), "band").withColumn("own", F.pmod(F.xxhash64("d1"), F.col("s")).cast("int"))
    e = e.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
    return e.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("s", "other")


def meet(a: str, b: str) -> Column:
    """The condition under which rows of cells() with these aliases meet: every pair of documents does in exactly one cell of a band."""
    same = (F.col(f"{a}.band") == F.col(f"{b}.band")) & (F.col(f"{a}.i") == F.col(f"{b}.i")) & (F.col(f"{a}.j") == F.col(f"{b}.j"))
    return same & ((F.col(f"{a}.i") == F.col(f"{a}.j")) | (F.col(f"{a}.own") != F.col(f"{b}.own")))


def candidate_pairs(docs: DataFrame) -> DataFrame:
    """(a1, b1): first digest halves of documents that share a band, the smaller first, each pair once.

    docs has one row per digest; two digests with the same first half only add candidates. Bands are counted with a
    partial sum and those of a single document go before anything is paired; the others meet in cells."""
    rows = docs.select("d1", F.explode("bands").alias("band"))
    e = cells(rows, rows.groupBy("band").agg(F.count("*").alias("k")).where("k > 1"))
    a, b = e.alias("a"), e.alias("b")
    return a.join(b, meet("a", "b") & (F.col("a.d1") < F.col("b.d1"))).select(F.col("a.d1").alias("a1"), F.col("b.d1").alias("b1")).distinct()


PAIR = "a1 long, a2 long, b1 long, b2 long, rep_a string, rep_b string"


def representatives(rows: DataFrame) -> DataFrame:
    """One row per digest of SIGNED rows, with `rep`, its least id, and `h`, the hash of that one's text."""
    return rows.groupBy("d1", "d2").agg(F.min(F.struct("id", "h")).alias("r"), *[F.first(c).alias(c) for c in ("n", "packed", "bands")]).select("d1", "d2", "r.h", F.col("r.id").alias("rep"), "n", "packed", "bands")


def texts_of(wanted: DataFrame, bodies: DataFrame, keys: list[str]) -> DataFrame:
    """keys and text of the rows of bodies whose keys, h among them, are wanted; written to the shared folder.

    A bitmap of h tells most other texts apart where they are read; what it lets through meets the wanted keys in one
    shuffle. The keys themselves never travel to all executors. They are distinct, so they are joined inner: Spark
    pushes a semi-join below the bitmap, and all texts would be shuffled before it."""
    wanted = cut(wanted.select(*keys).distinct())
    near = maybe(bodies.select(*keys, "text"), bitmap(wanted))
    return cut(near.select(*keys, "text").join(wanted.hint("merge"), keys))


def similar_pairs(rows: DataFrame, bodies: DataFrame, threshold: float, multiset: bool = True, shingle: int = 1) -> DataFrame:
    """(a1, a2, b1, b2, rep_a, rep_b, similarity): candidate pairs of digests with at least the threshold.

    The packed bits estimate first, then the texts decide: those of the representatives that are left are fetched
    from `bodies` (id, h, text) and compared exactly. h tells the texts of an id apart that came with several."""
    docs = cut(representatives(rows))
    side = lambda x, *c: docs.select(F.col("d1").alias(f"{x}1"), F.col("d2").alias(f"{x}2"), *[F.col(k).alias(f"{k}_{x}") for k in c])
    p = candidate_pairs(docs).join(side("a", "packed", "n"), "a1").join(side("b", "packed", "n"), "b1")
    ratio = F.least("n_a", "n_b") / F.greatest("n_a", "n_b")
    p = p.where((ratio >= threshold) & (estimate(F.col("packed_a"), F.col("packed_b")) >= LEAST_ESTIMATE)).select("a1", "a2", "b1", "b2")
    p = p.join(side("a", "rep", "h"), ["a1", "a2"]).join(side("b", "rep", "h"), ["b1", "b2"]).select("a1", "a2", "b1", "b2", "rep_a", "rep_b", "h_a", "h_b")
    p = cut(p)
    texts = texts_of(p.select(F.col("rep_a").alias("id"), F.col("h_a").alias("h")).unionByName(p.select(F.col("rep_b").alias("id"), F.col("h_b").alias("h"))), bodies, ["id", "h"])
    text = lambda x: texts.select(F.col("id").alias(f"rep_{x}"), F.col("h").alias(f"h_{x}"), F.col("text").alias(f"text_{x}"))
    p = p.join(text("a"), ["rep_a", "h_a"]).join(text("b"), ["rep_b", "h_b"]).select("a1", "a2", "b1", "b2", "rep_a", "rep_b", "text_a", "text_b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(6).to_pylist(), batch.column(7).to_pylist()
            s = pa.array([exact(x, y, multiset, shingle) for x, y in zip(a, b, strict=True)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], s], names=[*batch.schema.names[:6], "similarity"])

    return map_arrow(p, verify, PAIR + ", similarity double").where(F.col("similarity") >= threshold).distinct()
