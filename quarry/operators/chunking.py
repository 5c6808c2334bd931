"""Splitting files into chunks, by the structure their language has.

Python is split along its syntax tree (quality ast); the brace languages along declarations found in the text
without comments and strings, shell, Markdown and templates along their own marks (quality regex); all else at blank
lines or, for prose, into packs of sentences (text_fallback).
"""

from __future__ import annotations

import ast
import hashlib
import re
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.functions.lexing import closing, lex
from quarry.operators import references
from quarry.sources.session import map_arrow

MAX_CHARS, LEAST_CHARS, OVERLAP = 6000, 20, 8
PROSE = {"txt", "rst", "text"}


@dataclass
class Chunk:
    symbol_name: str
    symbol_type: str
    content: str
    start_line: int
    end_line: int
    quality: str
    parent: str | None = None
    place: int | None = None


def identity(path: str, symbol: str, content: str) -> str:
    """The chunk id of functions.search.chunk_id, in Python."""
    inner = hashlib.sha256(content.encode()).hexdigest()
    return hashlib.sha256(f"{len(path)}:{path}|{len(symbol)}:{symbol}|{inner}".encode()).hexdigest()[:32]


def signature(lines: list[str]) -> list[str]:
    """The first line and at most four more, while brackets stay open."""
    out, depth = [], 0
    for line in lines[:5]:
        out.append(line)
        depth += sum(line.count(c) for c in "([") - sum(line.count(c) for c in ")]")
        if depth <= 0:
            break
    return out


def split_long(path: str, c: Chunk, limit: int) -> list[Chunk]:
    """c itself, or its parts where it is longer than the limit; parts after the first repeat the signature and overlap."""
    if len(c.content) <= limit:
        return [c]
    lines = c.content.split("\n")
    head = signature(lines)
    room = max(500, limit - len("\n".join(head)) - 1)
    parts: list[tuple[int, int]] = []
    at = 0
    while at < len(lines):
        size, end = 0, at
        while end < len(lines) and (end == at or size + len(lines[end]) + 1 <= room):
            size += len(lines[end]) + 1
            end += 1
        parts.append((at, end))
        if end >= len(lines):
            break
        at = max(at + 1, end - OVERLAP, len(head)) if end > len(head) else end
    parent = identity(path, c.symbol_name, c.content)
    return [
        Chunk(c.symbol_name, c.symbol_type, "\n".join(lines[a:b]) if not i else "\n".join([*head, "", *lines[a:b]]), c.start_line + a, c.start_line + b - 1, c.quality, parent, i)
        for i, (a, b) in enumerate(parts)
    ]


def _piece(lines: list[str], a: int, b: int, name: str, kind: str, quality: str) -> list[Chunk]:
    """Lines a to b (0-based, b excluded) without blank lines at the ends; nothing if they are blank."""
    while a < b and not lines[a].strip():
        a += 1
    while b > a and not lines[b - 1].strip():
        b -= 1
    return [Chunk(name, kind, "\n".join(lines[a:b]), a + 1, b, quality)] if a < b else []


def blank_lines(text: str) -> list[Chunk]:
    lines, out, at = text.split("\n"), [], 0
    for i in range(len(lines) + 1):
        if i == len(lines) or not lines[i].strip():
            out += _piece(lines, at, i, "", "block", "text_fallback")
            at = i + 1
    return out


def prose(text: str, limit: int) -> list[Chunk]:
    """Sentences packed greedily up to the limit; an over-long sentence stands alone."""
    out: list[Chunk] = []
    pack: list[str] = []
    size, first, last = 0, 1, 1
    for m in re.finditer(r"\S[\s\S]*?(?:(?<=[.!?])(?=\s)|\Z)", text):
        s = m.group().strip()
        line = text.count("\n", 0, m.start()) + 1
        if pack and size + 1 + len(s) > limit:
            out.append(Chunk("", "block", " ".join(pack), first, last, "text_fallback"))
            pack, size = [], 0
        if not pack:
            first = line
        size += len(s) + (1 if pack else 0)
        pack.append(s)
        last = line + s.count("\n")
    if pack:
        out.append(Chunk("", "block", " ".join(pack), first, last, "text_fallback"))
    return out


def markdown(text: str) -> list[Chunk]:
    lines, heads, fence = text.split("\n"), [], ""
    for i, x in enumerate(lines):
        m = re.match(r"\s{0,3}(`{3,}|~{3,})", x)
        if m:
            if not fence:
                fence = m.group(1)
            elif m.group(1)[0] == fence[0] and len(m.group(1)) >= len(fence) and not x.strip().strip(fence[0]):
                fence = ""
        elif not fence and (h := re.match(r"(#{1,6})\s+(.+)$", x)):
            heads.append((i, h.group(2).strip()))
    if not heads:
        return _piece(lines, 0, len(lines), "", "block", "regex")
    out = _piece(lines, 0, heads[0][0], "", "block", "regex")
    for (i, name), (j, _) in zip(heads, [*heads[1:], (len(lines), "")], strict=True):
        out += _piece(lines, i, j, name, "module", "regex")
    return out


def bash(text: str) -> list[Chunk]:
    lines = text.split("\n")
    starts = [(i, m.group(1) or m.group(2)) for i, x in enumerate(lines) if (m := re.match(r"(?:function\s+(\w+)|(\w+)\s*\(\s*\))", x))]
    if not starts:
        return _piece(lines, 0, len(lines), "", "module", "regex")
    out = _piece(lines, 0, starts[0][0], "", "module", "regex")
    for (i, name), (j, _) in zip(starts, [*starts[1:], (len(lines), "")], strict=True):
        out += _piece(lines, i, j, name, "function", "regex")
    return out


def python(text: str) -> list[Chunk]:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        tree = ast.parse(text)
    lines, out = text.split("\n"), []
    span = lambda n: (min([n.lineno, *[d.lineno for d in getattr(n, "decorator_list", [])]]) - 1, n.end_lineno)
    defs = [n for n in tree.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))]
    first = span(defs[0])[0] if defs else len(lines)
    out += [c for c in _piece(lines, 0, first, "", "module", "ast") if len(c.content) > LEAST_CHARS]
    for n in tree.body:
        a, b = span(n)
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            out += _piece(lines, a, b, n.name, "function", "ast")
        elif isinstance(n, ast.ClassDef):
            methods = [m for m in n.body if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef))]
            taken = {i for m in methods for i in range(*span(m))}
            shell = [lines[i] for i in range(a, b) if i not in taken]
            out.append(Chunk(n.name, "class_shell", "\n".join(shell).rstrip(), a + 1, b, "ast"))
            for m in methods:
                out += _piece(lines, *span(m), f"{n.name}.{m.name}", "method", "ast")
        elif isinstance(n, (ast.Assign, ast.AnnAssign)) and a >= first:
            out += [c for c in _piece(lines, a, b, "", "assignment", "ast") if len(c.content) > LEAST_CHARS]
    return out


_EXPORT = r"^(?:export[ \t]+)?(?:default[ \t]+)?(?:declare[ \t]+)?"
_TOP = {
    "function": re.compile(_EXPORT + r"(?:async[ \t]+)?function[ \t]*\*?[ \t]*(\w+)", re.M),
    "class_shell": re.compile(_EXPORT + r"(?:abstract[ \t]+)?class[ \t]+(\w+)", re.M),
    "interface": re.compile(_EXPORT + r"interface[ \t]+(\w+)", re.M),
    "type_alias": re.compile(_EXPORT + r"type[ \t]+(\w+)[^=\n]*=", re.M),
    "enum": re.compile(_EXPORT + r"(?:const[ \t]+)?enum[ \t]+(\w+)", re.M),
    "variable": re.compile(_EXPORT + r"(?:const|let|var)[ \t]+(\w+)[^=\n]*=", re.M),
    "object": re.compile(r"^(?:export[ \t]+default[ \t]+|module\.exports[ \t]*=[ \t]*)(?:\w+\()?(?=\{)()", re.M),
}
_METHOD = re.compile(r"^[ \t]+(?:(?:public|private|protected|static|async|readonly|abstract|override|get|set)[ \t]+)*\#?(\w+)[ \t]*(?:<[^\n(]*>)?\([^;{}]*?\)[^;{}\n]*\{", re.M)
_WORDS = {"if", "for", "while", "switch", "catch", "return", "function", "with"}


def _line(text: str, at: int) -> int:
    return text.count("\n", 0, at)


def _lead(lines: list[str], a: int, low: int) -> int:
    """The first line of the comments and decorators directly above line a."""
    while a > low and re.match(r"\s*(?://|/?\*|#\[|@)", lines[a - 1]):
        a -= 1
    return a


def _members(lines: list[str], masked: str, name: str, a: int, b: int, open_at: int, end_at: int, pattern: re.Pattern, quality: str) -> list[Chunk]:
    """A class's shell and its methods."""
    taken: set[int] = set()
    out: list[Chunk] = []
    for m in pattern.finditer(masked, open_at, end_at):
        if m.group(1) in _WORDS or _line(masked, m.start(1)) in taken:
            continue
        brace = masked.find("{", m.end(1))
        e = closing(masked, brace)
        if e < 0:
            continue
        i, j = _lead(lines, _line(masked, m.start(1)), a + 1), _line(masked, e - 1) + 1
        out += _piece(lines, i, j, f"{name}.{m.group(1)}", "method", quality)
        taken |= set(range(i, j))
    shell = "\n".join(x for i, x in enumerate(lines[a:b], a) if i not in taken).rstrip()
    return [Chunk(name, "class_shell", shell, a + 1, b, quality), *out]


_PROPERTY = re.compile(
    r"(?:(?:async|get|set)[ \t]+)*\*?[ \t]*(?P<method>[A-Za-z_$][\w$]*)[ \t]*(?:<[^\n(]*>)?(?=\()|(?P<key>[A-Za-z_$][\w$]*|'[^'\n]*'|\"[^\"\n]*\")[ \t]*:[ \t]*(?P<kind>\{|(?:async[ \t]+)?function\b|(?:async[ \t]*)?(?:\((?=[^()]*(?:\([^()]*\)[^()]*)*\)[^=,{]*=>)|[\w$]+[ \t]*=>))?"
)


def _properties(text: str, masked: str, a: int, b: int) -> list[tuple[str, str, int, int]]:
    """(name, function, object or value, start, end) of the properties of the object whose braces enclose a to b."""
    out, at = [], a
    while at < b:
        at = re.compile(r"[\s,]*").match(masked, at, b).end()
        if at >= b:
            break
        depth, end = 0, at
        while end < b and (depth or masked[end] != ","):
            depth += (masked[end] in "([{") - (masked[end] in ")]}")
            end += 1
        m = _PROPERTY.match(text, at, b)
        if m and masked[at:end].strip():
            kind = "function" if m.group("method") or m.group("kind") and m.group("kind") != "{" else "object" if m.group("kind") else "value"
            out.append(((m.group("method") or m.group("key")).strip("'\""), kind, at, at + len(masked[at:end].rstrip())))
        at = end + 1
    return out


def _object(lines: list[str], text: str, masked: str, name: str, a: int, b: int, brace: int, depth: int = 0) -> list[Chunk] | None:
    """The shell of an object that has functions, without them, and the functions as name.key, objects in it likewise; None if it has none."""
    stop = closing(masked, brace)
    found = _properties(text, masked, brace + 1, stop - 1) if stop > 0 and depth < OBJECT_DEPTH else []
    if not any(kind == "function" for _, kind, _, _ in found):
        inner = [(_object(lines, text, masked, f"{name}.{key}".lstrip("."), _line(text, s), _line(text, e - 1) + 1, masked.find("{", s), depth + 1), s, e) for key, kind, s, e in found if kind == "object"]
        if not any(x for x, _, _ in inner):
            return None
    taken: set[int] = set()
    out: list[Chunk] = []
    for key, kind, s, e in found:
        label, i, j = f"{name}.{key}".lstrip("."), _lead(lines, _line(text, s), a + 1), _line(text, e - 1) + 1
        if kind == "value" or taken & set(range(i, j)) or i <= a or j > b:
            continue
        parts = _object(lines, text, masked, label, i, j, masked.find("{", s), depth + 1) if kind == "object" else _piece(lines, i, j, label, "method", "regex")
        if parts:
            out += parts
            taken |= set(range(i, j))
    shell = "\n".join(x for i, x in enumerate(lines[a:b], a) if i not in taken).rstrip()
    return [Chunk(name, "variable" if depth == 0 and name else "block", shell, a + 1, b, "regex"), *out] if taken else None


def script(text: str, jsx: bool = True) -> list[Chunk]:
    """TypeScript and JavaScript by their top-level declarations; components are Pascal-case functions that return markup."""
    masked, lines, found = lex(text, "ts")[0], text.split("\n"), []
    for kind, pattern in _TOP.items():
        found += [(m.start(), m.end(), kind, m.group(1)) for m in pattern.finditer(masked)]
    out, at = [], 0
    for s, e, kind, name in sorted(found):
        a = _line(text, s)
        if a < at:
            continue
        head = re.compile(r"[;{]|=>[ \t]*[^{\s(]").search(masked, e)
        stop = closing(masked, head.start()) if head and head.group() == "{" else (masked.find(";", e) + 1 or len(masked))
        paren = masked.find("(", e)
        if kind in ("function", "variable") and 0 <= paren < (head.start() if head else len(masked)):
            after = closing(masked, paren)
            brace = masked.find("{", after) if after > 0 else -1
            semi = masked.find(";", after) if after > 0 else -1
            if brace >= 0 and (kind == "function" or semi < 0 or brace < semi):
                stop = closing(masked, brace)
        stop = len(masked) if stop <= 0 else stop
        b = _line(text, stop - 1) + 1
        lead = _lead(lines, a, at)
        out += _piece(lines, at, lead, "", "module" if not out else "block", "regex")
        body = "\n".join(lines[a:b])
        if kind == "class_shell":
            out += _members(lines, masked, name, lead, b, masked.find("{", e) + 1, stop, _METHOD, "regex")
        elif kind in ("object", "variable") and re.match(r"\s*\{", masked[e:stop]) and (parts := _object(lines, text, masked, name, lead, b, masked.find("{", e))):
            out += parts
        else:
            kind = "block" if kind == "object" else kind
            function = kind == "function" or kind == "variable" and re.search(r"=>|\bfunction\b", body)
            markup = jsx and name[:1].isupper() and (re.search(r"<[A-Za-z][\w.]*[\s/>]|<>", body) or re.search(r"\b(?:memo|forwardRef|lazy)\(", body))
            out += _piece(lines, lead, b, name, "component" if function and markup else "function" if function else kind, "regex")
        at = b
    return [c for c in out + _piece(lines, at, len(lines), "", "block", "regex") if c.content.strip()]


_PHP_TYPE = re.compile(r"^(?:(?:abstract|final|readonly)[ \t]+)*(?:class|interface|trait|enum)[ \t]+(\w+)|^function[ \t]+&?(\w+)", re.M)
_PHP_METHOD = re.compile(r"^[ \t]+(?:(?:public|private|protected|static|abstract|final)[ \t]+)*function[ \t]+&?(\w+)[ \t]*\(", re.M)


_PHP_CODE = re.compile(r"<\?(?:php\b|=)")


def _php_markup(text: str) -> list[tuple[int, int]]:
    """The spans outside the tags of PHP: what stands before, between and behind its code."""
    out, at = [], 0
    quiet = lex(text, "php")[0]
    while m := _PHP_CODE.search(text, at):
        out.append((at, m.start()))
        end = quiet.find("?>", m.end())
        if end < 0:
            return out
        at = end + 2
    return [*out, (at, len(text))]


def php(text: str) -> list[Chunk]:
    """Types as shells with their methods, functions, and what stands between; markup outside the tags as blocks of its own."""
    masked, lines, out, at = lex(text, "php")[0], text.split("\n"), [], 0
    markup = {i for a, b in _php_markup(text) for i in range(_line(text, a) + (a > 0 and text[a - 1] != "\n"), _line(text, b)) if text[a:b].strip()}

    def between(a: int, b: int, kind: str) -> list[Chunk]:
        found, i = [], a
        while i < b:
            j = i
            while j < b and (j in markup) == (i in markup):
                j += 1
            found += _piece(lines, i, j, "", "block" if i in markup else kind, "regex")
            i = j
        return found

    for m in _PHP_TYPE.finditer(masked):
        a = _line(text, m.start())
        brace = masked.find("{", m.end())
        stop = closing(masked, brace) if brace >= 0 else -1
        if a < at or stop < 0 or a in markup:
            continue
        b, lead = _line(text, stop - 1) + 1, _lead(lines, a, at)
        out += between(at, lead, "module" if not out else "block")
        if m.group(1):
            out += _members(lines, masked, m.group(1), lead, b, brace + 1, stop, _PHP_METHOD, "regex")
        else:
            out += _piece(lines, lead, b, m.group(2), "function", "regex")
        at = b
    return out + between(at, len(lines), "block")


# Levels an over-long template or object is opened to; shorter markup joins what stands before it.
VUE_DEPTH, VUE_SCRAP, OBJECT_DEPTH = 3, 200, 3
# Elements of the markup language that have no content.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_TAG = re.compile(r"<!--[\s\S]*?(?:-->|\Z)|<(/?)([A-Za-z][\w.:-]*)((?:\"[^\"]*\"|'[^']*'|[^\"'>])*)>")


def _elements(text: str, a: int, b: int) -> list[tuple[int, int, str, int, int]]:
    """(start, end, name, inner start, inner end) of the outermost elements between a and b; an element that is not closed ends with its parent."""
    out, stack = [], []
    for m in _TAG.finditer(text, a, b):
        name = m.group(2)
        if name is None:
            continue
        if not m.group(1):
            if m.group(3).rstrip().endswith("/") or name.lower() in VOID:
                if not stack:
                    out.append((m.start(), m.end(), name, m.end(), m.end()))
            else:
                stack.append((name, m.start(), m.end()))
        elif any(n == name for n, _, _ in stack):
            while stack[-1][0] != name:
                stack.pop()
            n, s, inner = stack.pop()
            if not stack:
                out.append((s, m.end(), n, inner, m.start()))
    if stack:
        n, s, inner = stack[0]
        out.append((s, b, n, inner, b))
    return out


def _markup(text: str, a: int, b: int, limit: int, depth: int = 0) -> list[tuple[int, int]]:
    """Spans of lines (b excluded) that an element between the places a and b is cut into: whole if it is short, else its children in packs."""
    first, last = _line(text, a), _line(text, max(a, b - 1)) + 1
    children = [] if b - a <= limit or depth >= VUE_DEPTH else _elements(text, *next((e[3:] for e in _elements(text, a, b)[:1]), (a, a)))
    if not children:
        return [(first, last)]
    spans, at = [], first
    for s, e, *_ in children:
        i, j = _line(text, s), _line(text, e - 1) + 1
        if j <= at:
            continue
        if e - s > limit:
            if i > at:
                spans.append((at, i))
            spans += [(max(x, at), y) for x, y in _markup(text, s, e, limit, depth + 1) if y > at]
        else:
            spans.append((at, j))
        at = j
    if last > at:
        spans.append((at, last))
    size = lambda x, y: sum(len(z) + 1 for z in text.split("\n")[x:y])
    packed = [spans[0]]
    for x, y in spans[1:]:
        if size(packed[-1][0], y) <= limit or size(x, y) < VUE_SCRAP:
            packed[-1] = (packed[-1][0], y)
        else:
            packed.append((x, y))
    return packed


def vue(text: str, limit: int = MAX_CHARS) -> list[Chunk]:
    """A single-file component: its script as TypeScript with its own line numbers, its other elements whole, an over-long one by the elements in it."""
    lines, out = text.split("\n"), []
    for s, e, name, inner, end in _elements(text, 0, len(text)):
        if name == "script":
            base = _line(text, inner)
            body = text[inner:end]
            lead = len(body) - len(body.lstrip("\n"))
            for c in script(body[lead:] if body[:1] == "\n" else body):
                shift = base + (lead if body[:1] == "\n" else 0)
                c.start_line += shift
                c.end_line += shift
                out.append(c)
        else:
            label = name if name in ("template", "style") else ""
            for a, b in _markup(text, s, e, limit):
                out += _piece(lines, a, b, label, "block", "regex")
    return out or blank_lines(text)


# Directives of the template language that open a block, in lower case, with those that close it.
BLADE = {
    "auth": ("endauth",), "can": ("endcan",), "canany": ("endcanany",), "cannot": ("endcannot",), "component": ("endcomponent",), "empty": ("endempty",), "env": ("endenv",),
    "error": ("enderror",), "for": ("endfor",), "foreach": ("endforeach",), "forelse": ("endforelse",), "fragment": ("endfragment",), "guest": ("endguest",), "hassection": ("endif",),
    "if": ("endif",), "isset": ("endisset",), "once": ("endonce",), "php": ("endphp",), "prepend": ("endprepend",), "prependonce": ("endprependonce",), "production": ("endproduction",),
    "push": ("endpush",), "pushonce": ("endpushonce",), "section": ("endsection", "show", "stop", "append", "overwrite"), "sectionmissing": ("endif",), "session": ("endsession",),
    "slot": ("endslot",), "switch": ("endswitch",), "unless": ("endunless",), "verbatim": ("endverbatim",), "while": ("endwhile",),
}
# Blocks named by their first argument; those that are whole with a second one; levels an over-long block is opened to.
BLADE_NAMED = ("component", "fragment", "prepend", "prependonce", "push", "pushonce", "section", "slot")
BLADE_SHORT = ("section", "slot")
BLADE_DEPTH = 3
_DIRECTIVE = re.compile(r"(?<!@)@(\w+)")


def _arguments(text: str, at: int) -> tuple[str | None, int]:
    """What stands in the brackets that open at or after blanks from `at`, and the place behind them; None without brackets."""
    m = re.compile(r"[ \t]*\(").match(text, at)
    if m is None:
        return None, at
    depth, quote, i = 1, "", m.end()
    while i < len(text) and depth:
        c = text[i]
        if quote:
            i += c == "\\"
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        else:
            depth += (c in "([") - (c in ")]")
        i += 1
    return text[m.end() : i - 1], i


def _two(arguments: str) -> bool:
    """True if a comma stands outside quotes and inner brackets."""
    bare = re.sub(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"", "", arguments)
    while (less := re.sub(r"[(\[][^()\[\]]*[)\]]", "", bare)) != bare:
        bare = less
    return "," in bare


@dataclass
class _Block:
    label: str
    start: int
    end: int
    inner: list


def _blade_blocks(text: str) -> list[_Block]:
    """The outermost blocks with those in them. Comments and verbatim bodies open nothing; what is not closed ends with the text."""
    quiet = re.sub(r"\{\{--[\s\S]*?--\}\}|(?<=@verbatim)[\s\S]*?(?=@endverbatim)", lambda m: re.sub(r"[^\n]", " ", m.group()), text)
    top: list[_Block] = []
    stack: list[tuple[str, _Block]] = []
    for m in _DIRECTIVE.finditer(quiet):
        name = m.group(1).lower()
        if name in BLADE:
            arguments, _ = _arguments(text, m.end())
            if name == "php" and arguments is not None or name in BLADE_SHORT and arguments and _two(arguments) or name == "empty" and arguments is None:
                continue
            first = re.match(r"\s*['\"]([^'\"]+)['\"]", arguments or "") if name in BLADE_NAMED else None
            block = _Block(f"{name}:{first.group(1)}" if first else "", m.start(), len(text), [])
            (stack[-1][1].inner if stack else top).append(block)
            stack.append((name, block))
            continue
        at = next((i for i in range(len(stack) - 1, -1, -1) if name in BLADE[stack[i][0]]), None)
        if at is not None:
            for _, block in stack[at + 1 :]:
                block.end = m.start()
            stack[at][1].end = m.end()
            del stack[at:]
    return top


def blade(text: str, limit: int = MAX_CHARS) -> list[Chunk]:
    """A template by its outermost blocks, an over-long one by the blocks in it, down to BLADE_DEPTH levels; its parts keep its name."""
    lines, out = text.split("\n"), []

    def emit(blocks: list[_Block], a: int, b: int, name: str, depth: int) -> None:
        at = a
        for block in blocks:
            i, j = _line(text, block.start), _line(text, max(block.end - 1, block.start)) + 1
            if i < at:
                continue
            between(at, i, name)
            label = name or block.label
            if block.end - block.start > limit and block.inner and depth < BLADE_DEPTH:
                emit(block.inner, i, min(j, b), label, depth + 1)
            else:
                out.extend(_piece(lines, i, min(j, b), label, "section" if label.startswith("section:") else "block", "regex"))
            at = j
        between(at, b, name)

    def between(a: int, b: int, name: str) -> None:
        out.extend(_piece(lines, a, b, name, "section" if name.startswith("section:") else "block", "regex"))

    emit(_blade_blocks(text), 0, len(lines), "", 0)
    return out


def chunk_file(path: str, text: str, limit: int = MAX_CHARS) -> list[Chunk]:
    """The chunks of a file, long ones split; blank files have none. Files that do not parse fall back to blank lines."""
    name = path.lower()
    ext = name.rsplit(".", 1)[-1] if "." in name.rsplit("/", 1)[-1] else ""
    if not text.strip():
        return []
    try:
        if name.endswith(".blade.php"):
            found = blade(text, limit)
        elif ext in ("ts", "tsx", "js", "jsx", "mjs"):
            found = script(text, ext in ("tsx", "jsx", "js"))
        elif ext == "py":
            found = python(text)
        elif ext == "php":
            found = php(text)
        elif ext == "vue":
            found = vue(text, limit)
        elif ext in ("sh", "bash"):
            found = bash(text)
        elif ext in ("md", "markdown"):
            found = markdown(text)
        elif ext in PROSE:
            return prose(text, limit)
        else:
            found = blank_lines(text)
    except (SyntaxError, ValueError, RecursionError):
        found = blank_lines(text)
    return [p for c in found if c.content.strip() for p in split_long(path, c, limit)]


CHUNKS_DDL = "repo string, id string, file_path string, symbol_name string, symbol_type string, content string, start_line int, end_line int, parent_chunk_id string, sub_chunk_index int, search_quality string"
_FIELDS = [x.split() for x in CHUNKS_DDL.split(", ")]
#: Rows of chunk_and_refer that are references have their chunk's id and these, and nothing else but repo and path.
REFERENCE_DDL = "target_symbol string, ref_type string, place int"


def _batch(rows: list[tuple], fields: list[list[str]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(v, pa.int32() if t == "int" else pa.string()) for v, (_, t) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])


def _made(repo: str | None, path: str | None, text: str | None, limit: int) -> dict[str, tuple]:
    out = {}
    for c in chunk_file(path or "", text or "", limit):
        i = identity(path or "", c.symbol_name, c.content)
        out[i] = (repo, i, path, c.symbol_name, c.symbol_type, c.content, c.start_line, c.end_line, c.parent, c.place, c.quality)
    return out


def chunk_files(files: DataFrame, limit: int = MAX_CHARS) -> DataFrame:
    """The chunk rows of files (repo, file_path, content). No shuffle; equal chunks of a file collapse by their id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _batch([row for f in zip(*[c.to_pylist() for c in batch.columns], strict=True) for row in _made(*f, limit).values()], _FIELDS)

    return map_arrow(files.select("repo", "file_path", "content"), run, CHUNKS_DDL)


def chunk_and_refer(files: DataFrame, limit: int = MAX_CHARS) -> DataFrame:
    """The chunk rows of files and, with a ref_type, the references they make: id is then the chunk that holds the line, `place` the order within the file."""
    fields = _FIELDS + [x.split() for x in REFERENCE_DDL.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for repo, path, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                made = _made(repo, path, text, limit)
                rows += [(*r, None, None, None) for r in made.values()]
                refs = references.found(path or "", text or "") if made else []
                for n, (holder, (_, target, kind)) in enumerate(zip(references.holders([(r[6], r[7], r[1]) for r in made.values()], [line for line, _, _ in refs]), refs, strict=True)):
                    rows.append((repo, holder, path, *[None] * (len(_FIELDS) - 3), target, kind, n))
            yield _batch(rows, fields)

    return map_arrow(files.select("repo", "file_path", "content"), run, f"{CHUNKS_DDL}, {REFERENCE_DDL}")
