"""Functions paired with their documentation."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.lexing import closing, lex
from quarry.sources.session import map_arrow
from quarry.llm.languages import EXTENSIONS, extension, rank_languages

#: Words a description must have besides markers, tags, parameter lists and the words of the name.
LEAST_WORDS = 5

_MODIFIERS = r"(?:(?:public|private|protected|static|abstract|final|async|readonly|override|declare|export|default|get|set)[ \t]+)*"
_SIGNATURES = {
    "python": [re.compile(r"^[ \t]*(?:async[ \t]+)?def[ \t]+(?P<name>\w+)[ \t]*(?:\[[^\]\n]*\])?[ \t]*(?P<open>\()", re.M)],
    "js": [
        re.compile(rf"^[ \t]*{_MODIFIERS}function[ \t]*\*?[ \t]*(?P<name>[\w$]+)[ \t]*(?:<[^()\n]*>)?[ \t]*(?P<open>\()", re.M),
        re.compile(rf"^[ \t]*{_MODIFIERS}(?:const|let|var)[ \t]+(?P<name>[\w$]+)[ \t]*(?::[^=\n]+)?=[ \t]*(?:async[ \t]+)?(?:function\b[ \t]*\*?[ \t]*[\w$]*[ \t]*)?(?:<[^()\n]*>)?[ \t]*(?P<open>\()", re.M),
        re.compile(rf"^[ \t]*{_MODIFIERS}(?:const|let|var)[ \t]+(?P<name>[\w$]+)[ \t]*(?::[^=\n]+)?=[ \t]*(?:async[ \t]+)?(?:[\w$]+[ \t]*=>|(?:React\.)?(?:memo|forwardRef|lazy|observer)\b)", re.M),
        re.compile(rf"^[ \t]*{_MODIFIERS}\*?[ \t]*\#?(?P<name>[\w$]+)[ \t]*(?:<[^()\n]*>)?[ \t]*(?P<open>\()", re.M),
        re.compile(rf"^[ \t]*{_MODIFIERS}\#?(?P<name>[\w$]+)[ \t]*(?::[^=\n]+)?=[ \t]*(?:async[ \t]+)?(?P<open>\()", re.M),
    ],
    "php": [re.compile(rf"^[ \t]*{_MODIFIERS}function[ \t]+&?[ \t]*(?P<name>\w+)[ \t]*(?P<open>\()", re.M)],
    "sh": [re.compile(r"^[ \t]*(?:function[ \t]+(?P<name>[\w:.-]+)[ \t]*(?:\([ \t]*\))?|(?P<name2>[\w:.-]+)[ \t]*\([ \t]*\))\s*(?P<body>[{(])", re.M)],
}
_SIGNATURES["ts"] = _SIGNATURES["tsx"] = _SIGNATURES["js"]
#: Without any of these a text has no documentation at all: no comment, and no string where a body may begin.
_MAYBE = {
    "python": re.compile(r"\#|:\s*[rRuU]?[\"'(]"),
    "js": re.compile(r"//|\*/|\{\s*['\"]"),
    "php": re.compile(r"//|\*/|\#|\{\s*['\"]"),
    "sh": re.compile(r"\#"),
}
_MAYBE["ts"] = _MAYBE["tsx"] = _MAYBE["js"]
_NO_NAMES = frozenset("if for while switch catch return function with else do try typeof new await yield throw case in of import super constructor_ foreach elseif match".split())
_AFTER = {0: re.compile(r"\s*(?::[^={;]+(?:\{[^{}]*\})?)?\s*\{"), 1: re.compile(r"\s*(?::[^=;\n]+)?\s*(?:=>|\{)"), 3: re.compile(r"\s*(?::[^={;\n]+)?\s*\{"), 4: re.compile(r"\s*(?::[^=;\n]+)?\s*=>")}
_PY_AFTER = re.compile(r"[ \t]*(?:->[^:\n]+)?:")
_PHP_AFTER = re.compile(r"\s*(?::\s*[?\w\\|&]+)?\s*\{")


def _indented(masked: str, line_start: int, body: int) -> int:
    """The end of a Python body: where a line stands no deeper than the signature."""
    indent = re.compile(r"[ \t]*").match(masked, line_start).end() - line_start
    end = body
    first = masked.find("\n", body)
    if first < 0:
        return len(masked)
    for m in re.compile(r"^([ \t]*)(\S[^\n]*)?\n?", re.M).finditer(masked, first + 1):
        if m.group(2) and len(m.group(1)) <= indent:
            break
        if m.group(2):
            end = m.end()
        if m.end() >= len(masked):
            break
    return max(end, first)


_PLACEHOLDER = re.compile(
    r"\b(?:todo|fixme|xxx|tbd|tba|undocumented|placeholder|lorem ipsum)\b|\b(?:insert|add|write|put|fill in|needs?)\s+(?:a |the |some |your |in )?(?:doc(?:s|string|umentation)?|description|comment)s?\b"
    r"|\bno (?:description|documentation|docs?|comment)s?\b(?: is| are)?(?: yet)?(?: available| provided| given)?|\bdescription of (?:what|the|this)\b|\bgoes here\b|\bsee above\b|\binheritdoc\b|\bauto-?generated (?:method|function) stub\b|\bdocument(?:ed)? (?:me|this|later)\b",
    re.I,
)
_DIRECTIVE = re.compile(
    r"^\W*(?:eslint|tslint|jshint|jslint|prettier-|istanbul|c8 ignore|v8 ignore|@ts-|ts-|noqa|pylint|type:\s*ignore|mypy|ruff|flake8|pragma|nosec|fmt:|isort|yapf|pyright|shellcheck|phpcs|phpstan|psalm|@phpstan|@psalm|codecov|sonar|nolint|biome-|webpack|region\b|endregion\b|@internal\b|\{@)", re.I
)
_TAG = re.compile(r"^\s*(?:[@\\]\w+|:(?:param|returns?|rtype|raises?|type|arg|keyword|yields?|var|ivar|cvar)\b)", re.I)
_INLINE_TAG = re.compile(r"(?<=\s)(?:@(?:param|returns?|throws|raises|type)\b|:(?:param|returns?|raises|type)\b)", re.I)
_SECTION = re.compile(r"^\s*(?:args?|arguments|param(?:eter)?s|returns?|raises|yields|throws|examples?|attributes|usage|options|see also)\s*:?\s*$", re.I)
_CODE = re.compile(
    r"^\s*(?:[\w$.\[\]'\">:-]+\s*(?:[-+*/|&]?=(?!=)|:=)\s*\S.*|[\w$.>:-]*\w\(.*\)\s*[;:{]?|(?:if|for|while|foreach|switch|elif|else if)\b.*[:{]|(?:return|throw|raise|import|from|const|let|var|export|echo|def|class|function|use|await|yield|print)\b.*[;:{)\]]|[}\])]+[;,]?|\$?\w+=[\"$'].*)\s*$"
)
_WORDS = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|\d+")
_RULE = re.compile(r"^[\W_]*$")


def name_words(name: str) -> set[str]:
    return {w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+", name)}


def prose(lines: list[str], name: str) -> str | None:
    """The explaining text of a comment's or docstring's lines (markers already removed), or None if it is trivial.

    Tags with what follows them, parameter sections, directives, rules, disabled code and placeholders are left
    out; what remains must have LEAST_WORDS words that are not (inflected) words of the name."""
    kept: list[str] = []
    skipping = False
    for line in lines:
        s = line.strip()
        if not s:
            skipping = False
            continue
        if _TAG.match(s) and not _WORDS.match(s) or _SECTION.match(s):
            skipping = True
            continue
        if skipping or _DIRECTIVE.match(s) or _RULE.match(s) or s.startswith(("{@", "#!", "<<<<<<<", ">>>>>>>", "=======", ">>>")):
            continue
        inline = _INLINE_TAG.search(s)
        if inline:
            s, skipping = s[: inline.start()].rstrip(), True
        if s:
            kept.append(s)
    if not kept:
        return None
    if all(_CODE.match(s) for s in kept):
        return None
    text = " ".join(s for s in kept if not (_CODE.match(s) and s.endswith((";", "{", "}"))))
    sentences = re.split(r"(?<=[.!?:])\s+(?=[A-Z@`])", text)
    real = [s for s in sentences if not _PLACEHOLDER.search(s) or len(_WORDS.findall(s)) > 14]
    own = name_words(name)
    words = [w.lower() for w in _WORDS.findall(" ".join(real))]
    left = [w for w in words if w not in own and not any(len(o) > 2 and w.startswith(o[: max(3, len(o) - 1)]) and len(w) <= len(o) + 3 for o in own)]
    return " ".join(real) if len(left) >= LEAST_WORDS else None


def comment_lines(raw: str) -> list[str]:
    """A comment's lines without its markers."""
    if raw.startswith("/*"):
        body = re.sub(r"^/\*+!?|\*+/$", "", raw)
        return [re.sub(r"^\s*\*+(?!\*)[ \t]?", "", x) for x in body.split("\n")]
    return [re.sub(r"^\s*(?://+!?|\#+)[ \t]?", "", raw)]


def _literal(raw: str) -> str | None:
    m = re.match(r"[a-zA-Z]*", raw)
    if set(m.group().lower()) - {"r", "u"}:
        return None
    try:
        v = ast.literal_eval(raw)
        return v if isinstance(v, str) else None
    except (SyntaxError, ValueError):
        return raw[m.end() :].strip("\"'")


class _Source:
    def __init__(self, text: str, lang: str) -> None:
        self.text, self.lang = text, lang
        self.masked, self.comments, self.strings = lex(text, lang)
        self.ends = {}
        for s, e in self.comments:
            start = text.rfind("\n", 0, s) + 1
            if not text[start:s].strip():
                stop = text.find("\n", e)
                if not text[e : stop if stop >= 0 else len(text)].strip():
                    self.ends[text.count("\n", 0, e)] = (s, e)
        self.string_at = dict(self.strings)

    def above(self, at: int) -> list[str]:
        """The lines of the comment that ends on the line before `at`, decorators and attributes left aside."""
        line = self.text.count("\n", 0, at) - 1
        rows = self.masked.split("\n")
        depth = 0
        while line >= 0 and line not in self.ends:
            s = rows[line].strip()
            if not s and not self.text.split("\n")[line].strip():
                return []
            depth += sum(s.count(c) for c in ")]}") - sum(s.count(c) for c in "([{")
            if s.startswith(("@", "#[")) and depth <= 0 or depth > 0:
                line -= 1
                continue
            return []
        found: list[str] = []
        one_line = None
        while line in self.ends:
            s, e = self.ends[line]
            raw = self.text[s:e]
            block = raw.startswith("/*")
            if found and (block or one_line is False):
                break
            one_line = not block
            found = comment_lines(raw) + found
            line = self.text.count("\n", 0, s) - 1
        return found

    def first_string(self, at: int) -> list[str]:
        """The lines of the string (or adjacent strings) that is the first statement from `at` on."""
        parts: list[str] = []
        end = at
        gap = re.compile(r"[\s(]*")
        while True:
            stop = gap.match(self.masked, at).end()
            s = next((s for s, e in self.strings if at <= s and e <= stop), None)
            if s is None or parts and "\n" in self.text[end:s]:
                break
            v = _literal(self.text[s : self.string_at[s]])
            if v is None:
                return []
            parts.append(v)
            at = end = self.string_at[s]
        if not parts:
            return []
        rest = self.masked[end : self.masked.find("\n", end) if "\n" in self.masked[end:] else len(self.masked)].strip()
        return "".join(parts).split("\n") if not rest or rest[0] in ";)" else []


def functions(text: str, lang: str) -> list[tuple[str, str, int, int]]:
    """(name, description, start, end) of every documented function, method or component in the text."""
    if not _MAYBE[lang].search(text):
        return []
    src = _Source(text, lang)
    out, taken = [], set()
    for k, pattern in enumerate(_SIGNATURES[lang]):
        for m in pattern.finditer(src.masked):
            g = m.groupdict()
            name = g.get("name") or g.get("name2")
            start = m.start() + (len(m.group()) - len(m.group().lstrip()))
            if not name or name in _NO_NAMES or start in taken:
                continue
            after, body = m.end(), -1
            if g.get("open"):
                after = closing(src.masked, m.end() - 1)
                if after < 0:
                    after = m.end()
                    nxt = None
                else:
                    nxt = (_PY_AFTER if lang == "python" else _PHP_AFTER if lang == "php" else _AFTER.get(k, _AFTER[3])).match(src.masked, after)
                if nxt is None:
                    if lang != "js" and lang != "ts" and lang != "tsx" or k == 0:
                        if after != m.end() or lang in ("python", "php") and k:
                            continue
                        body = m.end()
                    else:
                        continue
                else:
                    body = nxt.end()
            else:
                body = m.end()
            taken.add(start)
            words = src.above(start)
            text_above = prose(words, name) if words else None
            if lang == "python":
                inner = src.first_string(body)
                described = (prose(inner, name) if inner else None) or text_above
                end = _indented(src.masked, src.masked.rfind("\n", 0, start) + 1, body)
            else:
                inner = src.first_string(body)
                described = text_above or (prose(inner, name) if inner else None)
                brace = body - 1 if src.masked[body - 1 : body] in ("{", "(") else src.masked.find("{", body)
                end = closing(src.masked, brace) if brace >= 0 else len(text)
                end = len(text) if end < 0 else end
            if described:
                out.append((name, described, start, end))
    return out


#: A token that only a language's own text has decides at once.
_OWN = {
    "python": re.compile(r"^[ \t]*(?:async[ \t]+)?def[ \t]+\w+[ \t]*\(", re.M),
    "js": re.compile(r"^[ \t]*(?:const|let)[ \t].*;[ \t\r]*$|^[ \t]*(?:export[ \t]+)?(?:async[ \t]+)?function[ \t]+[\w$]+\([^$\n]*\{[ \t\r]*$", re.M),
    "php": re.compile(r"^[ \t]*\$\w+.*;[ \t\r]*$|\bfunction[ \t]+\w+\([^)\n]*\$", re.M),
    "sh": re.compile(r"^[ \t]*(?:fi|done|esac)[ \t\r]*$|^[ \t]*(?:export|local)[ \t]+\w+=", re.M),
}
_FAMILIES = [_MAYBE[x] for x in ("python", "js", "php", "sh")]
_OWN["ts"] = _OWN["tsx"] = _OWN["js"]


def chunk_language(path: str | None, content: str) -> str | None:
    """The language of the extension, unless the tokens are clearly another's; None where the extension has no functions
    here or the text has neither a comment nor a string where a body may begin."""
    named = EXTENSIONS.get(extension(path))
    if named is None or not any(p.search(content) for p in _FAMILIES):
        return None
    if _OWN[named].search(content):
        return named
    ranked = [x for x in rank_languages(content) if x in _SIGNATURES]
    family = {"js": "c", "ts": "c", "tsx": "c"}
    if not ranked or named in ranked[:1] or family.get(named) == family.get(ranked[0], ranked[0]):
        return named
    return ranked[0] if named not in ranked[:2] or ranked[0] in ("python", "php") or named == "python" else named


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for i, path, content in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if i is None or not content:
                continue
            lang = chunk_language(path, content)
            if lang is not None:
                rows += [(i, path, n, d, content[s:e]) for n, d, s, e in functions(content, lang)]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["chunk_id", "file_path", "func_name", "description", "code"])


def documented_functions(chunks: DataFrame) -> DataFrame:
    """(chunk_id, file_path, func_name, description, code) of the documented functions in whole chunks.

    Signatures are found by pattern in the text without comments and strings; bodies end by bracket stack or,
    in Python, by indentation; the documentation is the string that is the body's first statement or the comment that
    ends on the line above, decorators between. Chunks without id or content, and files in languages without functions
    here, give nothing; ids delivered twice give one row; a function that occurs twice in a chunk with the same text
    counts once. No shuffle but for the de-duplication of what was found.
    """
    whole = chunks.where(F.coalesce(F.trim("parent_chunk_id"), F.lit("")) == "")
    return map_arrow(whole.select("id", "file_path", "content"), _pairs, "chunk_id string, file_path string, func_name string, description string, code string").distinct()
