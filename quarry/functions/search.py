"""Column expressions of the retrieval side: tokens, query classification, identity, bag-of-words buckets."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F



def _folds() -> tuple[str, str]:
    """Lower-case letters that Unicode decomposes into a letter and marks, up to the end of the extended Greek block, and these letters."""
    accented, plain = [], []
    for c in map(chr, range(0xC0, 0x2000)):
        d = unicodedata.normalize("NFD", c)
        if len(d) > 1 and c == c.lower() and d[0].isalpha() and all(unicodedata.combining(x) for x in d[1:]):
            accented.append(c)
            plain.append(d[0])
    return "".join(accented), "".join(plain)


#: Letters with marks and what the full-text tokenizer makes of them.
ACCENTED, PLAIN = _folds()
# Weights of the kinds of query words.
QUESTION_WORDS = ["how", "why", "what", "where", "when", "which", "does", "is"]
QUALITY = {"ast": 1.0, "regex": 0.85, "text_fallback": 0.7}
RRF_K = 15
# The forms of words that look like symbols.
PASCAL, SNAKE, CAMEL, DOTTED = r"[A-Z][a-z]+(?:[A-Z][a-z]+)+", r"[a-z]+(?:_[a-z]+)+", r"[a-z]+(?:[A-Z][a-z]+)+", r"\w+\.\w+"
# What is left out of an index unless configured otherwise.
EXCLUDES = ["node_modules/", "__pycache__/", ".git/", "dist/", "build/", "*.min.js", "*.map", "*.lock", "package-lock.json", "*.pyc", ".env", "venv/", ".venv/", ".mypy_cache/", ".ruff_cache/", ".pytest_cache/", "*.egg-info/"]


def terms(c: Column) -> Column:
    """The folded letter-digit runs of a text as an array; a null text has none."""
    low = F.lower(F.coalesce(c, F.lit("")))
    folded = F.when(F.octet_length(low) == F.char_length(low), low).otherwise(F.translate(low, ACCENTED, PLAIN))  # a text of ASCII has no marks
    return F.regexp_extract_all(folded, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def words(c: Column) -> Column:
    """The white-space separated words of a query; none for null and blank ones."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != "")


def phrases(c: Column) -> Column:
    """The phrases of a query: each word, freed of `" ' * ^` and leading dashes, as its array of terms; empty ones are ignored."""
    clean = F.transform(words(c), lambda w: F.regexp_replace(F.translate(w, "\"'*^", ""), "^-+", ""))
    return F.filter(F.transform(clean, terms), lambda t: F.size(t) > 0)


def symbol_weight(c: Column) -> Column:
    """How much a query looks like a symbol: -0.1 a question word, +0.3 PascalCase, +0.2 snake_case, +0.2 dotted, +0.1 camelCase, summed over words."""
    raw = F.transform(words(c), lambda x: F.regexp_replace(x, r"^[()\[\]{}:;,.]+|[()\[\]{}:;,.]+$", ""))

    def worth(x: Column) -> Column:
        return (
            F.when(F.lower(x).isin(QUESTION_WORDS), -0.1).otherwise(0.0)
            + F.when(x.rlike(f"^{PASCAL}$"), 0.3).otherwise(0.0)
            + F.when(x.rlike(f"^{SNAKE}$"), 0.2).otherwise(0.0)
            + F.when(x.rlike(f"^{DOTTED}$"), 0.2).otherwise(0.0)
            + F.when(x.rlike(f"^{CAMEL}$"), 0.1).otherwise(0.0)
        )

    return F.aggregate(F.transform(raw, worth), F.lit(0.0), lambda a, x: a + x)


def symbol_candidates(c: Column) -> Column:
    """The words of a query that look like symbols, in order, repeats kept."""
    raw = F.transform(words(c), lambda x: F.regexp_replace(x, r"""^[()\[\]{}:;,.'"?]+|[()\[\]{}:;,.'"?]+$""", ""))
    return F.filter(raw, lambda x: x.rlike(f"^(?:{PASCAL}|{SNAKE}|{CAMEL}|{DOTTED})$"))


def chunk_id(path: Column, symbol: Column, content: Column) -> Column:
    """The identity of a chunk: 32 hex digits of the hash over length-prefixed path and symbol and the content's hash."""
    sized = lambda x: F.concat(F.length(x).cast("string"), F.lit(":"), x)
    return F.substring(F.sha2(F.concat_ws("|", sized(path), sized(symbol), F.sha2(content, 256)), 256), 1, 32)


def quality_factor(c: Column) -> Column:
    """The weight of a chunk's search quality; unknown and null ones count fully."""
    return reduce(lambda w, kv: w.when(c == kv[0], kv[1]), list(QUALITY.items()), F.when(F.lit(False), 1.0)).otherwise(1.0)


def bucket(word: Column, dim: int) -> Column:
    """The bag-of-words bucket of a word: the first four bytes of its md5, little-endian, modulo dim."""
    m = F.md5(word)
    hexes = F.concat(F.substring(m, 7, 2), F.substring(m, 5, 2), F.substring(m, 3, 2), F.substring(m, 1, 2))
    return F.conv(hexes, 16, 10).cast("long") % dim


def glob_regex(pattern: str) -> str:
    """A shell pattern as an anchored regular expression; `*` also matches `/`."""
    out = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern)
    return f"(?s)^{out}$"


def excluded(path: Column, patterns: list[str]) -> Column:
    """True where the path, or one of its components with or without a slash behind it, matches a pattern."""
    whole = "|".join(glob_regex(p) for p in patterns)
    return path.rlike(whole) | F.exists(F.split(path, "/"), lambda c: c.rlike(whole) | F.concat(c, F.lit("/")).rlike(whole))


def inside(path: Column) -> Column:
    """True for a path that stays within its repository: not null or empty, not absolute, no step up, no backslash, no null character."""
    return F.coalesce((path != "") & ~path.rlike(r"(^|/)\.\.(/|$)|^/|^[A-Za-z]:|\\|\x00"), F.lit(False))
