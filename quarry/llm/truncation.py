"""Texts that stop before their end."""

from __future__ import annotations

import ast
import hashlib
import re
import warnings
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.bitmaps import bitmap, maybe
from quarry.llm.minhash import WordHashes, cells, meet, mix, texts_of
from quarry.sources.session import map_arrow
from quarry.sources.tables import cut

#: Words of a shingle, and the share of a copy's shingles that the longer text must have.
SHINGLE, THRESHOLD = 5, 0.8
#: Openings of LEAST_OPENING words, twice, four times as many and so on are signed by OPENING_BANDS bands of OPENING_ROWS minima:
#: equal openings always meet, those of similarity 0.9 but for 0.0015, of 0.8 but for 0.028.
LEAST_OPENING, OPENING_BANDS, OPENING_ROWS = 8, 5, 3
#: Different words a task counts before it hands its counts on.
WORDS_KEPT = 200_000
#: A length is a field limit if at least LIMIT_ROWS different texts of a source have it and they exceed what the
#: lengths within LIMIT_REACH of it lead to expect by LIMIT_SIGMAS standard deviations and LIMIT_ROWS. Cuts that lost white space
#: or part of a word lie up to LIMIT_TRIM below one; at least LIMIT_PILE texts must lie there, and the limit must be LIMIT_TIMES
#: that distance, as lengths of short texts vary by it of themselves.
LIMIT_ROWS, LIMIT_REACH, LIMIT_SIGMAS, LIMIT_TRIM, LIMIT_PILE, LIMIT_TIMES = 3, 48, 6.0, 7, 12, 14
#: A last line's form is a usual ending if this share of its kind's texts, and at least two, end in it (or, where it
#: begins with a sign, of another kind's); from COMMON_SHARE on its last word is not looked at.
#: Lines of more than USUAL_WORDS words are sentences, not forms.
USUAL_SHARE, COMMON_SHARE, USUAL_WORDS = 0.0075, 0.03, 18
#: Stray characters are looked for among so many leading signs of a last line; up to STRAY_AFTER signs behind them go too.
STRAY, STRAY_AFTER = 14, 5
#: Short last lines that recur in so many different texts, and in this share of their kind's, are formulas (thanks, +1), and so are
#: last words that end more texts than they stand inside of;
#: before dots of omission whole sentences of FORMULA_WORDS are, whatever their share.
FORMULA, FORMULA_SHARE, FORMULA_WORDS = 3, 0.002, 5
#: A word seen OFTEN inside lines ends fewer than RARELY of them: a text that ends in it was cut.
OFTEN, RARELY = 30, 0.004
#: A last word is a fragment if it stands inside texts at most this many times as often as the words it begins do.
FRAGMENT = 0.002

_TERMINAL = re.compile(r"""[.!?。！？؟।…]['"»”’)\]`*_]*$""")
_SURE = re.compile(r"\s*(?:\[\s*(?:\.\.\.|…|truncated|cut|snip|more|continued|clipped)\s*\]|\((?:more|truncated|cut|continued|snip)(?:\s*\.\.\.)?\)|<(?:cut|truncated|snip|more)>|�+)$", re.I)
_DOTS = re.compile(r"\s*(?:\.{3,}|…)$")
_PART = re.compile(r"https?://\S+|\w[\w\-/]*(?:[./\\][\w\-/]+)+|\d+(?:\.\d+)*|\w+|\s+|.", re.S)
_WORD = re.compile(r"\w+")
#: ASCII with a blank for every sign that stands in no word.
_BLANKED = "".join(c if _WORD.match(c) else " " for c in map(chr, range(128)))
#: A line's last word, read backwards.
_LINE_END = re.compile(r"[.,;:!?)\]}`'\"]{0,2}(\w+)")
_STRAY = re.compile(r"[^\x20-\x7e\n\t]|\w{20}|\d[\d.]{7}|\s{3}")


def words_of(text: str) -> list[str]:
    """The text's words, as _WORD finds them."""
    return text.translate(_BLANKED).split() if text.isascii() else _WORD.findall(text)


def form(line: str) -> list[str]:
    """The line's signs: each number as 0, path or address as p, capitalised word as W, other word as w, others themselves."""
    out = []
    for t in _PART.findall(line.strip()):
        c = t[0]
        if c.isspace():
            out.append(" ")
        elif c.isdigit() and t.replace(".", "").isdigit():
            out.append("0")
        elif "/" in t or ("." in t and len(t) > 1):
            out.append("p")
        elif c.isalpha() or c == "_":
            out.append("W" if c.isupper() else "w")
        else:
            out.append(t)
    return out


#: Signs of no meaning here are stepped over before each token, or else every one of them would be tried as its start.
_LEX = {
    "c": re.compile(r"""[^/"'`()\[\]{}]*+(?://[^\n]*|/\*.*?\*/|(?P<open>/\*)|"[^"\\\n]*(?:\\.[^"\\\n]*)*"|'[^'\\\n]*(?:\\.[^'\\\n]*)*'|`[^`\\]*(?:\\.[^`\\]*)*`|(?P<quote>["'`])|(?P<b>[()\[\]{}])|/|\Z)""", re.S),
    "php": re.compile(r"""[^/\#"'()\[\]{}]*+(?:(?://|\#(?!\[))[^\n]*|/\*.*?\*/|(?P<open>/\*)|"[^"\\]*(?:\\.[^"\\]*)*"|'[^'\\]*(?:\\.[^'\\]*)*'|(?P<quote>["'])|(?P<b>[()\[\]{}])|[/\#]|\Z)""", re.S),
    "sh": re.compile(r"""\\.|(?<!\S)\#[^\n]*|"(?:[^"\\]|\\.)*"|'[^']*'|(?P<quote>["'])|\$\{[^}\n]*\}|(?P<b>[()\[\]{}])|(?:(?<=\n)|(?<=;)|(?<=^)|(?<=do)|(?<=then)|(?<=else))[ \t]*(?P<k>if|fi|do|done|case|esac|while|for|until)\b|;[ \t]*(?P<k2>do|then|fi|done)\b""", re.S),
}
_PAIR = {")": "(", "]": "[", "}": "{"}


def language(text: str, lang: str | None) -> str | None:
    """python, c (JavaScript and TypeScript), php or sh, by the given name or, failing that, by the text."""
    name = (lang or "").strip().lower()
    known = {"python": "python", "py": "python", "javascript": "c", "js": "c", "typescript": "c", "ts": "c", "tsx": "c", "jsx": "c", "php": "php", "bash": "sh", "sh": "sh", "shell": "sh"}
    if text.startswith("#!") and "sh" in text.split("\n", 1)[0]:
        return "sh"
    if "<?php" in text[:200]:
        return "php"
    if name in known:
        return known[name]
    if re.search(r"^(?:import \{|export |const \w+ =|function \w+\()", text, re.M):
        return "c"
    if re.search(r"^(?:from [\w.]+ import |import \w+$|(?:async )?def \w+\(|class \w+.*:$)", text, re.M):
        return "python"
    return None


def unfinished(text: str, lang: str | None) -> bool:
    """True if source text ends inside something it opened: a bracket, string, comment, block or statement."""
    kind = language(text, lang)
    if kind is None:
        return False
    if kind == "python":
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                ast.parse(text.lstrip("﻿"))
        except SyntaxError as e:
            last = text.rstrip().count("\n") + 1
            return (e.end_lineno or e.lineno or last) >= last or "never closed" in (e.msg or "") or "unterminated" in (e.msg or "")
        except (ValueError, RecursionError, MemoryError):
            return False
        return False
    stack: list[str] = []
    words = Counter()
    for m in _LEX[kind].finditer(text):
        g = m.lastgroup
        if g is None:
            continue
        if g == "b":
            b = m.group("b")
            if b in _PAIR:
                if stack and stack[-1] == _PAIR[b]:
                    stack.pop()
            else:
                stack.append(b)
        elif g in ("k", "k2"):
            words[m.group(g)] += 1
        elif kind in ("php", "sh") or g == "open" or m.group("quote") == "`" or "\n" not in text[m.end() :]:
            return True
    if kind == "sh" and (words["if"] > words["fi"] or words["do"] > words["done"] or words["case"] > words["esac"]):
        return True
    if stack and not (kind == "sh" and set(stack) <= {"(", "["}):
        return True
    return bool(re.search(r"(?:[=+\-*/<,|&.(\[{]|\b(?:return|const|let|var|new|import|from|function|class|extends)|->|::)$", text.rstrip())) and kind != "sh"


SURVEY = pa.schema([
    ("doc_id", pa.int64()), ("source", pa.string()), ("kind", pa.string()), ("h", pa.int64()), ("chars", pa.int32()), ("bytes", pa.int32()), ("code", pa.bool_()),
    ("open", pa.bool_()), ("mark", pa.string()), ("terminal", pa.bool_()), ("forms", pa.list_(pa.string())), ("line", pa.string()), ("word", pa.string()), ("whole", pa.bool_()),
    ("size", pa.int32()), ("bands", pa.list_(pa.int64())), ("n", pa.int64()), ("ends", pa.int64()),
])
SURVEY_DDL = "doc_id long, source string, kind string, h long, chars int, bytes int, code boolean, open boolean, mark string, terminal boolean, forms array<string>, line string, word string, whole boolean, size int, bands array<long>, n long, ends long"


def bare(text: str) -> str:
    """The text without blanks and characters of no width at its end."""
    return text.rstrip().rstrip("\u200b\u200c\u200d\ufeff").rstrip()


def unmarked(text: str) -> tuple[str, str]:
    """(mark, rest): sure or dots where a mark of omission stands at the text's end, else empty; the text before it."""
    if m := _SURE.search(text[-40:]):
        return "sure", text[: len(text) - len(m.group())].rstrip()
    if m := _DOTS.search(text[-40:]):
        return "dots", text[: len(text) - len(m.group())].rstrip()
    return "", text


def tail(text: str, kind: str | None, lang: str | None, parts: tuple[str, str] | None = None) -> tuple:
    """What SURVEY has of a text from `code` to `whole`; parts is what unmarked() makes of it bare, if that is known."""
    mark, t = parts or unmarked(bare(text))
    code = (kind or "").strip().lower() == "source_file"
    fences = len(re.findall(r"^[ \t>]*```", t, re.M)) if "```" in t else 0
    opened = unfinished(text if mark != "sure" else t, lang) if code else fences % 2 == 1
    block = t.rsplit("\n\n", 1)[-1]
    lines = block.split("\n")
    line = lines[-1]
    at = len(lines) - 1
    while at and 55 <= len(lines[at - 1]) <= 90 and not lines[at - 1][:1].isspace() and not _TERMINAL.search(lines[at - 1][-12:]) and not re.match(r"\s*(?:[-*>#|+]|\d+[.)])", lines[at]):
        at -= 1
        line = lines[at] + " " + line
    words = _WORD.findall(line)
    last = _WORD.search(t[-80:][::-1])
    word = last.group()[::-1] if last and last.start() == 0 else ""
    signs = form(line) if len(words) <= USUAL_WORDS else []
    forms = []
    if signs:
        stray = max((k for k, x in enumerate(_PART.findall(line.strip())[:STRAY]) if _STRAY.search(x)), default=-1) if _STRAY.search(line) else -1
        forms = list(dict.fromkeys("".join(signs[k:]).strip() for k in [0, *range(stray + 1, min(stray + 1 + STRAY_AFTER, len(signs)))][: None if stray >= 0 else 1]))
    if mark == "dots":
        sentence = re.split(r"[.!?。！？]\s*", t.replace("\n", " "))[-1].strip().lower()
        key = sentence if len(_WORD.findall(sentence)) >= FORMULA_WORDS else ""
    else:
        key = re.sub(r"\d+", "0", line.strip()) if len(words) <= 4 else ""
    ends = bool(_TERMINAL.search(t[-12:])) or bool(re.search(r"(?:^|\s)\|$", t[-3:]) and line.lstrip().startswith("|"))
    return code, opened, mark, ends, forms, key or None, word, t.endswith("```") and fences % 2 == 0


class _LowerHashes(WordHashes):
    def __missing__(self, word: str) -> int:
        low = word.lower()
        if low != word:
            h = self[word] = self[low]
            return h
        return super().__missing__(word)


_HASHES = _LowerHashes()
_STATE = mix(np.arange(1, 2 * OPENING_BANDS * OPENING_ROWS + SHINGLE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_MULTIPLY, _ADD, _PLACES = np.split(_STATE, [OPENING_BANDS * OPENING_ROWS, 2 * OPENING_BANDS * OPENING_ROWS])
_MULTIPLY, _ADD = (_MULTIPLY >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (_ADD >> np.uint64(32)).astype(np.uint32)


def openings(texts: list[list[str]]) -> list[np.ndarray]:
    """The bands of every text (as words): OPENING_BANDS for its first LEAST_OPENING words, then for twice as many, as far as it goes.

    The minima of an opening are those of the one before and of the shingles that came in addition, so all openings of
    a text cost one pass over its shingles; shingles beyond the last opening are not hashed. All texts are laid end to
    end; the SHINGLE - 1 places that would reach into the next text are segments of their own and fall away."""
    rungs = [(len(w) // LEAST_OPENING).bit_length() for w in texts]
    sizes = np.array([LEAST_OPENING << (n - 1) if n else 0 for n in rungs])
    total = int(sizes.sum())
    if not total:
        return [np.empty(0, dtype=np.int64) for _ in texts]
    h = np.zeros(total + SHINGLE - 1, dtype=np.uint64)
    h[:total] = np.fromiter(map(_HASHES.__getitem__, chain.from_iterable(w[:n] for w, n in zip(texts, sizes.tolist(), strict=True))), np.uint64, total)
    x = h[:total] * _PLACES[0]
    for i in range(1, SHINGLE):
        x += h[i : total + i] * _PLACES[i]
    x = (mix(x) >> np.uint64(32)).astype(np.uint32)
    offsets = [[0, *[(LEAST_OPENING << k) - SHINGLE + 1 for k in range(n)]] for n in range(max(rungs) + 1)]
    begins = (np.cumsum(sizes) - sizes).tolist()
    first = np.concatenate([np.array(offsets[n]) + b for n, b in zip(rungs, begins, strict=True) if n])
    kept = np.concatenate([[True] * n + [False] for n in rungs if n])
    low = np.empty((len(_MULTIPLY), int(kept.sum())), dtype=np.uint64)
    for i in range(len(_MULTIPLY)):
        low[i] = np.minimum.reduceat(x * _MULTIPLY[i] + _ADD[i], first)[kept]
    rung = np.concatenate([np.arange(n) for n in rungs if n])
    for k in range(1, int(rung.max()) + 1):
        here = np.flatnonzero(rung == k)
        low[:, here] = np.minimum(low[:, here], low[:, here - 1])
    bands = np.empty((len(rung), OPENING_BANDS), dtype=np.uint64)
    for b in range(OPENING_BANDS):
        v = mix((rung * OPENING_BANDS + b + 1).astype(np.uint64))
        for i in range(b * OPENING_ROWS, (b + 1) * OPENING_ROWS):
            v = mix(v ^ mix(low[i] + np.uint64(i)))
        bands[:, b] = v
    flat, ends = bands.view(np.int64).reshape(-1), np.cumsum(rungs) * OPENING_BANDS
    return [flat[e - n * OPENING_BANDS : e] for n, e in zip(rungs, ends.tolist(), strict=True)]


def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (doc_id, h, text, source, kind, lang), one pass over the texts: SURVEY of every text that is not blank, and rows of words.

    A text's `size` is its number of words and `bands` are those of its openings, without a mark of omission. A row of a
    word has no doc_id but `n`, how often the word stands before the last word of a text (marks left out), and `ends`, how
    often of these at the end of a line that is too short to be wrapped; each task sums its words."""
    seen: Counter = Counter()
    ends: Counter = Counter()

    def counted() -> pa.RecordBatch:
        words = list(seen)
        cols = {"word": words, "n": list(seen.values()), "ends": [ends.get(w, 0) for w in words]}
        out = pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(len(words), f.type) for f in SURVEY], schema=SURVEY)
        seen.clear()
        ends.clear()
        return out

    for batch in batches:
        out, texts = [], []
        for i, h, t, source, kind, lang in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if t is None or not t.strip():
                continue
            mark, u = unmarked(bare(t))
            words = words_of(u)
            seen.update(words[:-1])
            ends.update([m.group(1)[::-1] for x in u.split("\n")[:-1] if 0 < len(x) < 50 and (m := _LINE_END.match(x[:-41:-1]))])
            texts.append(words)
            out.append((i, source, (kind or "").strip().lower(), h, len(t), len(t.encode("utf-8", "replace")), *tail(t, kind, lang, (mark, u)), len(words)))
        if out:
            cols = [*zip(*out, strict=True), openings(texts), None, None]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if c is not None else pa.nulls(len(out), f.type) for c, f in zip(cols, SURVEY, strict=True)], schema=SURVEY)
        if len(seen) > WORDS_KEPT:
            yield counted()
    yield counted()


def field_limits(t: DataFrame) -> DataFrame:
    """(source, unit, length, exact): lengths, in characters or bytes, at which a source's different texts pile up.

    exact: at that very length; else the lengths LIMIT_TRIM below it pile up together, as trimmed cuts do, and
    LIMIT_TRIM above it there is next to nothing."""
    texts = t.groupBy("source", "h").agg(F.max("chars").alias("chars"), F.max("bytes").alias("bytes"))
    sizes = texts.select("source", F.explode(F.map_from_arrays(F.array(F.lit("chars"), F.lit("bytes")), F.array("chars", "bytes"))).alias("unit", "length"))
    at = sizes.groupBy("source", "unit", "length").agg(F.count("*").alias("n"))
    span = lambda a, b: F.coalesce(F.sum("n").over(Window.partitionBy("source", "unit").orderBy("length").rangeBetween(a, b)), F.lit(0))
    beyond = lambda n, usual: (n >= LIMIT_ROWS) & (n >= usual + LIMIT_SIGMAS * F.sqrt(usual) + LIMIT_ROWS - 1)
    at = at.withColumn("near", span(-LIMIT_REACH, LIMIT_REACH)).withColumn("beside", span(-1, 1) - F.col("n"))
    at = at.withColumn("exact", beyond(F.col("n"), F.greatest((F.col("near") - F.col("n")) / (2 * LIMIT_REACH), F.col("beside") / 2, F.lit(0.05)))).withColumn("m", F.col("n"))
    at = at.withColumn("n", F.when(F.col("exact"), 0).otherwise(F.col("n")))
    at = at.withColumn("near", span(-LIMIT_REACH, LIMIT_REACH)).withColumn("pile", span(-LIMIT_TRIM, 0)).withColumn("top", span(-2, 0)).withColumn("above", span(1, LIMIT_TRIM + 1))
    many = F.greatest((F.col("near") - F.col("pile")) / (2 * LIMIT_REACH - LIMIT_TRIM) * (LIMIT_TRIM + 1), F.lit(0.2))
    exact = F.col("exact")
    trimmed = (F.col("length") >= LIMIT_TIMES * LIMIT_TRIM) & beyond(F.col("pile"), many) & (F.col("pile") >= LIMIT_PILE) & (F.col("pile") >= 3 * many) & (F.col("top") >= LIMIT_ROWS) & (F.col("above") * 8 <= F.col("pile"))
    return at.where(exact | trimmed).select("source", "unit", "length", exact.alias("exact"))


def stands(last: DataFrame, words: DataFrame) -> DataFrame:
    """(word, inside, ends, begun) of each word of last, from rows (word, n, ends) of words: how often it stands inside texts, how
    often of these at the end of a line, and how often the longer words do that it begins (null: none that is there twice).

    Every word is counted once and then read with all its beginnings; a bitmap tells the few that are asked for apart,
    so what is counted is all that is shuffled, and only once."""
    counted = words.groupBy("word").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends")).withColumn("size", F.length("word"))
    least = F.when((F.col("n") >= 2) & F.col("size").between(2, 40), 1).otherwise(F.col("size"))
    parts = counted.select("*", F.explode(F.sequence(least, F.col("size"))).alias("k")).withColumn("word", F.substring(F.col("word"), F.lit(1), F.col("k")))
    parts = maybe(parts.withColumn("h", F.xxhash64("word")), bitmap(last.select(F.xxhash64("word").alias("h"))))
    whole = F.col("k") == F.col("size")
    sums = parts.groupBy("word").agg(F.sum(F.when(whole, F.col("n"))).alias("inside"), F.sum(F.when(whole, F.col("ends"))).alias("ends"), F.sum(F.when(~whole, F.col("n"))).alias("begun"))
    return last.join(sums, "word", "left").select("word", F.coalesce("inside", F.lit(0)).alias("inside"), F.coalesce("ends", F.lit(0)).alias("ends"), "begun")


def early_ends(t: DataFrame, bodies: DataFrame) -> DataFrame:
    """(h): hashes of texts that are copies of a longer one and whose alignment with it ends early.

    t has the rows of SURVEY of the documents, bodies (h, text). A copy cut anywhere shares its longest signed opening with
    the whole text, however much of that it lost; so the last bands of texts without closing punctuation meet all bands
    of longer texts, in cells where they are common. Of a verified pair, that is where the longer text has 0.8 or more of
    the other's five-word shingles, the words are aligned from the copy's last ones back."""
    rows = t.where(F.size("bands") > 0).select(F.col("h").alias("d1"), "size", ~F.col("terminal") | (F.col("mark") != ""), F.size("bands").alias("m"), F.posexplode("bands").alias("at", "band")).toDF("d1", "size", "suspect", "m", "at", "band")
    rows = rows.select("d1", "size", "band", (F.col("suspect") & (F.col("at") >= F.col("m") - OPENING_BANDS)).alias("last"))
    asked = rows.where("last").select("band").distinct()
    near = cut(rows.join(asked.hint("merge"), "band", "left_semi").groupBy("band", "d1").agg(F.max("size").alias("size"), F.max("last").alias("last")))
    sizes = near.groupBy("band").agg(F.count("*").alias("k"), F.min("size").alias("least"), F.max("size").alias("most"))
    e = cells(near, cut(sizes.where("k > 1 and least < most")))
    a, b = e.where("last").alias("a"), e.alias("b")
    p = cut(a.join(b, meet("a", "b") & (F.col("a.size") < F.col("b.size"))).select(F.col("a.d1").alias("h_a"), F.col("b.d1").alias("h_b")).distinct())
    texts = texts_of(p.select(F.col("h_a").alias("h")).unionByName(p.select(F.col("h_b").alias("h"))), bodies, ["h"]).dropDuplicates(["h"])
    text = lambda x: texts.select(F.col("h").alias(f"h_{x}"), F.col("text").alias(f"text_{x}"))
    return map_arrow(p.join(text("a"), "h_a").join(text("b"), "h_b").select("h_a", "text_a", "text_b"), _align, "h long").distinct()


def contained(x: list[str], y: list[str]) -> float:
    """The share of x's shingles that y has."""
    s = {tuple(x[i : i + SHINGLE]) for i in range(len(x) - SHINGLE + 1)}
    return len(s & {tuple(y[i : i + SHINGLE]) for i in range(len(y) - SHINGLE + 1)}) / max(1, len(s))


def ends_early(a: str, b: str) -> bool:
    """True if a's words run along b's up to a's end while b goes on in the same sentence."""
    x, y = _WORD.findall(a.lower()), _WORD.findall(b.lower())
    if len(x) >= len(y) or len(x) < 8:
        return False
    stem, n = x[-8:-1], len(x)
    for at in range(max(0, n - n // 4 - 8), min(len(y), n + n // 4) - 7):
        if y[at : at + 7] == stem:
            last = y[at + 7]
            if last == x[-1]:
                rest = re.search(rf"(?i)\b{re.escape(stem[-1])}\W+{re.escape(last)}(.?)", b)
                return at + 8 < len(y) and bool(rest) and rest.group(1) not in "" and rest.group(1) not in ".!?\n" and not _TERMINAL.search(a.rstrip())
            return last.startswith(x[-1])
    return False


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for h, a, b in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            a = unmarked(bare(a))[1]
            # the last shingle holds the word that may be cut
            if contained(_WORD.findall(a.lower())[:-1], _WORD.findall(b.lower())) >= THRESHOLD and ends_early(a, b):
                found.append(h)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["h"])


def truncated(documents: DataFrame) -> DataFrame:
    """doc_id, source and `reason` of every document whose text was cut off; the first reason of: limit, copy, mark, open, ending.

    limit: the text's length is one at which its source's texts pile up. copy: it is the copy of a longer text that ends
    early. mark: a mark of omission stands at its end, unless the same ending recurs as a formula. open: source
    text ends inside something it opened, or a code fence is open. ending: it ends neither with closing
    punctuation nor in a form that is usual at the end of its kind of text, or in the middle of a known word.
    One pass over the texts gives all that is counted. Counts are over all different texts of a kind; they are joined to
    the documents by key, and only the few hundred field limits and the kinds are broadcast. Null, empty and blank texts are
    no cases; doc_ids are unique.
    """
    body = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text", "source", "kind", "lang")
    passed = cut(map_arrow(body, survey, SURVEY_DDL))
    t, words = passed.where("n is null").drop("n", "ends"), passed.where("n is not null")
    limits = cut(field_limits(t).groupBy("source").agg(F.collect_list(F.struct("unit", "length", "exact")).alias("limits")).withColumnRenamed("source", "limited"))
    size = lambda x: F.when(x["unit"] == "chars", F.col("chars")).otherwise(F.col("bytes"))
    within = F.filter("limits", lambda x: (size(x) == x["length"]) | (~x["exact"] & size(x).between(x["length"] - LIMIT_TRIM, x["length"])))
    t = t.join(F.broadcast(limits), F.col("source").eqNullSafe(F.col("limited")), "left").withColumn("limit", F.array_max(F.transform(within, lambda x: x["exact"]))).drop("limits", "limited", "size", "bands")
    copies = early_ends(passed.where("n is null"), body.select("h", "text").where("text is not null")).withColumn("copy", F.lit(True))
    dotted = (F.col("mark") == "dots").alias("dotted")
    u = cut(t.groupBy("kind", "h").agg(
        F.first(F.when(F.size("forms") > 0, F.col("forms")[0])).alias("form"), F.first("line").alias("line"), F.first("mark").alias("mark"), F.first("word").alias("word"), F.first("terminal").alias("terminal"), F.max(F.col("limit").isNull()).alias("free")
    ))
    kinds = u.groupBy("kind").agg(F.count("*").alias("kind_n"))
    usual = u.where("mark = '' and free and form is not null").groupBy("kind", "form").agg(F.count("*").alias("form_n"))
    usual = usual.join(F.broadcast(kinds), "kind").where(F.col("form_n") >= F.greatest(F.lit(2.0), F.when(F.col("form") == "p", 0.0).otherwise(USUAL_SHARE) * F.col("kind_n")))
    usual = cut(usual.where((F.length("form") > 2) | (F.col("form") == "p")).withColumn("share", F.col("form_n") / F.col("kind_n")).select("kind", "form", "share"))
    doubtful = t.where(~F.col("terminal") & ~F.col("code")).select("doc_id", "kind", F.explode("forms").alias("form"))
    signs = usual.where(~F.col("form").rlike("^[wWp0]")).groupBy("form").agg(F.max("share").alias("share"))
    shares = usual.unionByName(signs.withColumn("kind", F.lit(None).cast("string"))).select(F.col("kind").alias("of"), "form", "share")
    best = doubtful.join(shares, "form").where(F.col("of").isNull() | (F.col("of") == F.col("kind"))).groupBy("doc_id").agg(F.max("share").alias("share"))
    lines = u.where("line is not null").groupBy("kind", "line", dotted).agg(F.count("*").alias("line_n")).join(F.broadcast(kinds), "kind")
    lines = lines.where(F.col("line_n") >= F.greatest(F.lit(float(FORMULA)), F.when(F.col("dotted"), 0.0).otherwise(FORMULA_SHARE * F.col("kind_n")))).select("kind", "line", "dotted", F.lit(True).alias("formula"))
    last = u.where(~F.col("terminal") & (F.col("word") != ""))
    inside = cut(stands(last.select("word").distinct(), words))
    odd = inside.select(
        "word", F.when(F.col("inside") <= FRAGMENT * F.col("begun"), "broken").when((F.col("inside") >= OFTEN) & (F.col("ends") < RARELY * F.col("inside")), "never").alias("odd")
    ).where("odd is not null")
    closing = last.groupBy("kind", "word").agg(F.count("*").alias("word_n")).join(F.broadcast(kinds), "kind")
    closing = closing.where(F.col("word_n") >= F.greatest(F.lit(float(FORMULA)), FORMULA_SHARE * F.col("kind_n"))).join(inside, "word").where("inside <= word_n").select("kind", "word", F.lit(True).alias("closing"))
    # A text that ends properly, at no limit and without a mark, has no reason: the rest is joined.
    t = t.where(~F.col("terminal") | (F.col("mark") != "") | F.col("open") | F.col("limit").isNotNull()).select("doc_id", "source", "kind", "h", "code", "open", "mark", "terminal", "whole", "line", "word", "limit")
    j = t.join(best, "doc_id", "left").withColumn("dotted", F.col("mark") == "dots").join(lines, ["kind", "line", "dotted"], "left").join(odd, "word", "left").join(closing, ["kind", "word"], "left")
    return j.join(copies, "h", "left").select("doc_id", "source", _reason().alias("reason")).where("reason is not null")


def _reason() -> Column:
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    formula = yes("formula") | (yes("closing") & (F.col("mark") == ""))
    odd = (F.col("odd") == "broken") | ((F.col("odd") == "never") & (F.col("share") < COMMON_SHARE))
    unusual = ~F.col("code") & ~F.col("terminal") & ~F.col("whole") & ~formula & (F.col("share").isNull() | F.coalesce(odd, F.lit(False)))
    return (
        F.when(yes("limit") | (F.col("limit").isNotNull() & (~F.col("terminal") | F.col("code"))), "limit").when(yes("copy"), "copy")
        .when((F.col("mark") == "sure") | ((F.col("mark") == "dots") & ~formula & ~(F.col("code") & ~F.col("open"))), "mark")
        .when(F.col("open"), "open").when(unusual & (F.col("mark") == ""), "ending")
    )
