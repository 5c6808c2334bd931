"""References a source file makes: imports, base classes and decorators, each with the line it stands on."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

# What counts as a reference in each language.
PATTERNS = {
    "py": [
        ("import", r"^from\s+([\w.]+)\s+import\s+(.+?)(?:\s+#.*)?$"),
        ("import", r"^import\s+([\w.]+)"),
        ("inherits", r"^class\s+\w+\(([^)]+)\)"),
        ("decorator", r"^@([\w.]+)"),
    ],
    "ts": [
        ("import", r"import\s+\{([^}]+)\}\s+from\s+['\"][^'\"]+['\"]"),
        ("import", r"import\s+(\w+)\s+from\s+['\"][^'\"]+['\"]"),
    ],
    "php": [
        ("import", r"^\s*use\s+(?:function\s+|const\s+)?([\w\\]+)(?:\s+as\s+\w+)?\s*;"),
        ("inherits", r"\b(?:class|interface)\s+\w+\s+extends\s+([\w\\,\s]+?)\s*(?:\{|implements\b)"),
        ("inherits", r"\bimplements\s+([\w\\,\s]+?)\s*\{"),
    ],
}
_COMPILED = {k: [(kind, re.compile(p, re.M)) for kind, p in v] for k, v in PATTERNS.items()}
_ROUTES = {"py": "py", "pyi": "py", "ts": "ts", "tsx": "ts", "js": "ts", "jsx": "ts", "mjs": "ts", "cjs": "ts", "vue": "ts", "php": "php"}


def route(path: str) -> str | None:
    """The language whose patterns hold for a file; None for templates and all others."""
    name = path.lower().rsplit("/", 1)[-1]
    return None if name.endswith(".blade.php") or "." not in name else _ROUTES.get(name.rsplit(".", 1)[1])


def _names(lang: str, place: int, groups: tuple[str, ...]) -> Iterator[str]:
    """The targets of one match: listed names one by one, aliases dropped, Python's with their module."""
    if lang == "py" and place == 0:
        for x in groups[1].strip("() \t").split(","):
            name = x.split(" as ")[0].strip()
            if name and name != "*":
                yield f"{groups[0]}.{name}"
    elif lang == "py" and place == 2:
        yield from (b for x in groups[0].split(",") if (b := x.split("[")[0].strip()) and b != "object")
    elif lang == "ts" and place == 0:
        yield from (n for x in groups[0].split(",") if (n := x.split(" as ")[0].strip()))
    elif lang == "php":
        yield from (n for x in groups[0].split(",") if (n := x.strip().lstrip("\\")))
    else:
        yield groups[0]


def found(path: str, text: str) -> list[tuple[int, str, str]]:
    """(line, target, kind) of the references in a file, pattern by pattern in the order of the text; lines from 1."""
    lang = route(path)
    if lang is None:
        return []
    breaks = [m.start() for m in re.finditer("\n", text)]
    return [(bisect_right(breaks, m.start() - 1) + 1, name, kind) for place, (kind, p) in enumerate(_COMPILED[lang]) for m in p.finditer(text) for name in _names(lang, place, m.groups())]


def holders(spans: list[tuple[int, int, str]], lines: list[int]) -> list[str]:
    """For each line the chunk that holds it: the last of (start, end, id) to start at or before it, if it reaches the line; else the file's first chunk."""
    spans = sorted(spans, key=lambda s: s[0])
    starts = [s[0] for s in spans]
    out = []
    for line in lines:
        i = bisect_right(starts, line) - 1
        out.append(spans[i][2] if i >= 0 and line <= spans[i][1] else spans[0][2])
    return out
