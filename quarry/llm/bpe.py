"""Byte-level BPE of a whole corpus through an index of pair occurrences."""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.sources.session import map_arrow

#: Where the vocabulary files of the public tokenizers lie unless a call names another folder.
TOKENIZERS = "/opt/tokenizers"
#: Pieces whose ids a worker keeps.
KEPT = 1_000_000
#: Positions of a pair from which on they are replaced as arrays, not one by one; the ids are the same.
MANY = 32
# How the vocabulary's authors split text into pieces.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same pattern where the text is ASCII only.
_ASCII = re.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\s\dA-Za-z]+|\s+(?!\S)|\s+""", re.ASCII)
_FULL = regex.compile(PIECES)


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else the next from U+0100."""
    kept = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in kept else chr(next(spare)) for b in range(256)]


class PairIndexEncoder:
    """Encodes many pieces at once. Pieces seen before are looked up; the new ones of a batch are laid end to end
    and every pair of neighbours is indexed by all its positions. The pair of the least rank is then replaced at
    all its positions together, the pairs that come and go beside them are entered, until no pair has a rank."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        self.first = [vocab[c] for c in byte_letters()]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.rank[vocab[a], vocab[b]] = (r, vocab[a + b])
        self.known: dict[str, bytes] = {}
        self.sizes: dict[str, int] = {}

    def learn(self, pieces: list[str]) -> None:
        """Enters the ids of new pieces in self.known, as little-endian int32."""
        rank, first = self.rank, self.first
        raw = [p.encode("utf-8", "replace") for p in pieces]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        ends = np.cumsum(sizes + 1)
        starts = ends - sizes - 1
        laid = np.full(int(ends[-1]), -1, dtype=np.int64)
        inner = np.ones(len(laid), dtype=bool)
        inner[ends - 1] = False
        laid[inner] = np.array(first, dtype=np.int64)[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        n = len(laid)
        # one place more than there are symbols: what comes before the first and after the last
        sym, after, before, taken = np.append(laid, -1), np.arange(1, n + 2), np.arange(-1, n), np.zeros(n + 1, dtype=bool)
        syms, afters, befores = memoryview(sym), memoryview(after), memoryview(before)
        where: dict[tuple[int, int], list[int]] = {}
        both = laid[:-1] << 32 | (laid[1:] & 0xFFFFFFFF)
        order = np.argsort(both, kind="stable")
        cuts = np.flatnonzero(np.diff(both[order])) + 1
        for places in np.split(order, cuts):
            i = int(places[0]) if len(places) else -1
            pair = (int(laid[i]), int(laid[i + 1])) if i >= 0 else None
            if pair in rank:
                where[pair] = places.tolist()
        where_get, rank_get = where.get, rank.get
        active = [(*rank[p], p) for p in where]
        heapq.heapify(active)
        while active:
            _, new, pair = heapq.heappop(active)
            a, b = pair
            places = where.pop(pair, None)
            if places is None:
                continue
            if a == b:
                places.sort()
            if len(places) >= MANY:
                i = np.array(places)
                i = i[sym[i] == a]
                j = after[i]
                fits = sym[j] == b
                i, j = i[fits], j[fits]
                if a == b and len(i):  # of a run of overlapping pairs every second one is replaced
                    nth = np.arange(len(i))
                    begins = np.append(True, i[1:] != j[:-1])
                    fits = (nth - np.maximum.accumulate(np.where(begins, nth, 0))) % 2 == 0
                    i, j = i[fits], j[fits]
                k = after[j]
                sym[i], sym[j] = new, -2
                after[i], before[k] = k, i
                h = before[i]
                taken[i] = True
                left = ~taken[h]  # where it is taken too, the pair was met from there
                taken[i] = False
                for at, beside, right in ((i, sym[k], True), (h[left], sym[h[left]], False)):
                    order = np.argsort(beside, kind="stable")
                    beside, at = beside[order], at[order].tolist()
                    cuts = [0, *(np.flatnonzero(np.diff(beside)) + 1).tolist(), len(at)]
                    for c, start, stop in zip(beside[cuts[:-1]].tolist() if at else (), cuts, cuts[1:]):
                        q = (new, c) if right else (c, new)
                        r = rank_get(q)
                        if r is not None:
                            if q in where:
                                where[q] += at[start:stop]
                            else:
                                where[q] = at[start:stop]
                                heapq.heappush(active, (*r, q))
                continue
            for i in places:
                if syms[i] != a:
                    continue
                j = afters[i]
                if syms[j] != b:
                    continue
                syms[i], syms[j] = new, -2
                k = afters[j]
                afters[i], befores[k] = k, i
                c = syms[k]
                if c >= 0:
                    q = (new, c)
                    at = where_get(q)
                    if at is not None:
                        at.append(i)
                    else:
                        r = rank_get(q)
                        if r is not None:
                            where[q] = [i]
                            heapq.heappush(active, (*r, q))
                h = befores[i]
                c = syms[h]
                if c >= 0:
                    q = (c, new)
                    at = where_get(q)
                    if at is not None:
                        at.append(h)
                    else:
                        r = rank_get(q)
                        if r is not None:
                            where[q] = [h]
                            heapq.heappush(active, (*r, q))
        flat = sym[:n].astype(np.int32)
        kept = flat >= 0
        upto = np.concatenate(([0], np.cumsum(kept)))
        ids = flat[kept].tobytes()
        for p, s, e in zip(pieces, upto[starts].tolist(), upto[ends - 1].tolist(), strict=True):
            self.known[p] = ids[4 * s : 4 * e]
            self.sizes[p] = e - s

    def split(self, texts: list[str | None]) -> list[list[str]]:
        """The pieces of every text, all of them known afterwards."""
        split = [(_ASCII if t.isascii() else _FULL).findall(t) if t else [] for t in texts]
        known = self.known
        if len(known) > KEPT:
            known.clear()
            self.sizes.clear()
        new = {p for s in split for p in s if p not in known}
        if new:
            self.learn(list(new))
        return split

    def encode(self, texts: list[str | None]) -> list[bytes]:
        get = self.known.__getitem__
        return [b"".join(map(get, s)) for s in self.split(texts)]

    def count(self, texts: list[str | None]) -> list[int]:
        """The number of ids of every text."""
        get = self.sizes.__getitem__
        return [sum(map(get, s)) for s in self.split(texts)]


@lru_cache(maxsize=4)
def encoder(path: str) -> PairIndexEncoder:
    return PairIndexEncoder(path)


def _ids(path: str, counts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            if counts:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(e.count(batch.column(1).to_pylist()), pa.int32())], names=["key", "ids"])
                continue
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                out = e.encode(part.column(1).to_pylist())
                sizes = np.array([len(x) // 4 for x in out], dtype=np.int32)
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(np.frombuffer(b"".join(out), dtype="<i4")))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["key", "ids"])

    return run


def token_ids(df: DataFrame, key: str, text: str, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, ids array<int>) of every row, without special tokens, whose strings are ordinary text.

    Null and empty texts have the empty list. No shuffle; a worker keeps the ids of the pieces it has seen, at
    most KEPT of them, and texts of any length are encoded whole. Repeated and null keys are kept as they are."""
    kind = df.schema[key].dataType.simpleString()
    return map_arrow(df.select(F.col(key).alias("key"), F.col(text).alias("text")), _ids(f"{folder}/{tokenizer}.json", False), f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def token_counts(df: DataFrame, key: str, text: str, tokenizers: list[str], folder: str = TOKENIZERS) -> DataFrame:
    """(key, tokenizer, n_tokens int) for every tokenizer, in one pass over the texts: byte-level vocabularies (.json) by the
    pair index, sentence-piece ones (.model) by their library."""
    kind = df.schema[key].dataType.simpleString()
    parts = [_pieces(f"{folder}/{t}.model") if t.startswith("piece") else _ids(f"{folder}/{t}.json", True) for t in tokenizers]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, part in zip(tokenizers, parts, strict=True):
                for out in part(iter((batch,))):
                    yield pa.RecordBatch.from_arrays([out.column(0), pa.array([name] * out.num_rows, pa.string()), out.column(1)], names=["key", "tokenizer", "n_tokens"])

    return map_arrow(df.select(F.col(key).alias("key"), F.col(text).alias("text")), run, f"key {kind}, tokenizer string, n_tokens int").withColumnRenamed("key", key)


@lru_cache(maxsize=2)
def _processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


_UNIT = re.compile(r" +[^ \n]+|\n[^ \n]+|[^ \n]+|\n| +")


class UnitCounter:
    """Counts the ids of texts by a sentence-piece model. Where no piece of the vocabulary has a space behind another
    sign or a line break anywhere, no id reaches over the start of a unit (a word with the spaces or the line break before it),
    so the units of an ASCII text are counted one by one, and those seen before are looked up; other texts, those that
    begin with a space (which joins the one the model puts before a text), and all where the vocabulary has such pieces, are encoded whole."""

    def __init__(self, path: str) -> None:
        self.model = _processor(path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.apart = not any("\u2581" in p.lstrip("\u2581") or "\n" in p for p in pieces) and len(self.model.encode("\n")) == 2
        self.known: dict[str, int] = {}

    def count(self, texts: list[str | None]) -> list[int]:
        out: list[int] = [0] * len(texts)
        apart = [bool(t) and self.apart and t[0] != " " and t.isascii() for t in texts]
        whole = [i for i, t in enumerate(texts) if t and not apart[i]]
        for i, ids in zip(whole, self.model.encode([texts[i] for i in whole], num_threads=1), strict=True):
            out[i] = len(ids)
        rest = [i for i, a in enumerate(apart) if a]
        units = [_UNIT.findall(texts[i]) for i in rest]
        if len(self.known) > KEPT:
            self.known.clear()
        new = list({u for s in units for u in s if u not in self.known})
        # the model puts a space before what it is given: it stands for the first of a unit's own, or is one too many before a line break
        for u, ids in zip(new, self.model.encode([u[1:] if u[0] == " " else u for u in new], num_threads=1), strict=True):
            self.known[u] = 1 if u == " " else len(ids) - (u[0] == "\n")
        get = self.known.__getitem__
        for i, s in zip(rest, units, strict=True):
            out[i] = sum(map(get, s)) + (texts[i][0] == "\n")
        return out


@lru_cache(maxsize=2)
def unit_counter(path: str) -> UnitCounter:
    return UnitCounter(path)


def _pieces(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = unit_counter(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counter.count(batch.column(1).to_pylist()), pa.int32())], names=["key", "ids"])

    return run
