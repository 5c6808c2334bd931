"""Source text without its comments and strings."""

from __future__ import annotations

import re

_TEMPLATE = r"`(?:[^`\\]|\\.)*`"
_LEXERS = {
    "python": r"""(?P<comment>\#[^\n]*)|(?P<string>\b[rRbBuUfF]{0,2}(?:\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?:\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'))""",
    "js": rf"""(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|{_TEMPLATE})""",
    "php": r"""(?P<comment>(?://|\#(?!\[))[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')""",
    "sh": r"""\\.|(?P<comment>(?<![^\s;])\#[^\n]*)|(?P<string>"(?:[^"\\]|\\.)*"|'[^']*')""",
}
_LEXERS = {k: re.compile(p, re.S) for k, p in _LEXERS.items()}
_LEXERS["ts"] = _LEXERS["tsx"] = _LEXERS["js"]
_INK = re.compile(r"[^\n]")


def lex(text: str, lang: str) -> tuple[str, list[tuple[int, int]], list[tuple[int, int]]]:
    """(masked, comments, strings): the text with both blanked out, line breaks kept, and their spans."""
    comments, strings, out, at = [], [], [], 0
    for m in _LEXERS[lang].finditer(text):
        if m.lastgroup is None:
            continue
        s, e = m.span()
        (comments if m.lastgroup == "comment" else strings).append((s, e))
        out += [text[at:s], _INK.sub(" ", text[s:e])]
        at = e
    out.append(text[at:])
    return "".join(out), comments, strings


def closing(masked: str, at: int) -> int:
    """The place after the bracket that closes the one at `at`, or -1."""
    depth = 0
    for m in re.compile(r"[()\[\]{}]").finditer(masked, at):
        depth += 1 if m.group() in "([{" else -1
        if depth == 0:
            return m.end()
    return -1
