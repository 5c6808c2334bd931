"""Languages of source text, by extension and by tokens."""

from __future__ import annotations

import re
from collections import Counter

#: Language of each extension, lower case; files of others have no grammar here.
EXTENSIONS = {"py": "python", "ts": "ts", "tsx": "tsx", "js": "js", "php": "php", "sh": "sh"}

_TOKEN = re.compile(
    r"[A-Za-z_]\w*|<(?:\?php|!DOCTYPE|/?[A-Za-z]\w*)|\$(?:this->|\(|(?=[A-Za-z_]))|\"\$|[-=]>|[!=]==|:(?::|[ \t]*(?:string|number|boolean|void|unknown)\b|$)|/>|\[[ \t]+-\w"
    r"|^(?:#!.*|```|#{1,6}[ \t]+[A-Z]|[ \t]*(?:[-*]|\d+\.)[ \t]+\w+[^;{}\n]*$)",
    re.M,
)
#: What a token speaks for, and how strongly.
_SPEAKS: dict[str, dict[str, int]] = {
    "python": {"def": 3, "elif": 3, "except": 2, "self": 2, "None": 3, ":": 2, "import": 1, "from": 1, "class": 1, "True": 1, "False": 1, "lambda": 1, "async": 1},
    "php": {"<?php": 4, "$this->": 2, "$": 1, "->": 1, "::": 1, "namespace": 2, "use": 1, "function": 1, "echo": 1},
    "sh": {"fi": 3, "done": 3, "esac": 3, "then": 2, "do": 1, "echo": 2, '"$': 2, "$(": 2, "[ -": 2, "local": 1, "set": 1, "#!": 4},
    "js": {"=>": 2, "const": 2, "let": 2, "var": 2, "===": 2, "!==": 2, "function": 1, "import": 1, "export": 1, "class": 1, "async": 1},
    "ts": {"interface": 3, ": type": 3, "type": 2, "private": 2, "public": 1, "protected": 1, "readonly": 2, "enum": 1},
    "tsx": {"</": 2, "/>": 3, "className": 3},
    "html": {"<!DOCTYPE": 4, "<html": 4, "<head": 4, "<body": 4, "<title": 4, "<p": 4, "</html": 4, "</head": 4, "</body": 4, "</title": 4, "</p": 4},
    "markdown": {"# ": 1, "- ": 1, "```": 1},
}
_OF: dict[str, list[tuple[str, int]]] = {}
for _lang, _tokens in _SPEAKS.items():
    for _t, _w in _tokens.items():
        _OF.setdefault(_t, []).append((_lang, _w))


def _kinds(token: str) -> tuple[str, ...]:
    """The names under which a token is looked up."""
    c = token[0]
    if c == "#":
        return ("#!" if token.startswith("#!") and "sh" in token else "# ",)
    if c == "[":
        return ("[ -",)
    if c == ":":
        return (token if len(token) < 3 else ": type",)
    if token.startswith("</"):
        return (token, "</")
    return ("- ",) if c in " \t-*" and token != "->" or c.isdigit() else (token,)


def extension(path: str | None) -> str:
    name = (path or "").rsplit("/", 1)[-1].rsplit("\\", 1)[-1]
    return name.rsplit(".", 1)[1].lower() if "." in name else ""


def rank_languages(text: str) -> list[str]:
    """Languages by the tokens of theirs that the text has, most first; those without any are left out.

    TypeScript counts JavaScript's tokens as well, and tsx those of both."""
    n: Counter = Counter()
    for token, times in Counter(_TOKEN.findall(text)).items():
        for kind in _kinds(token):
            for lang, weight in _OF.get(kind, ()):
                n[lang] += weight * times
    if n["ts"] or n["tsx"]:
        if n["js"] or n["ts"] > 2:
            n["ts"] += n["js"] if n["ts"] else 0
            n["tsx"] += max(n["js"], n["ts"]) if n["tsx"] else 0
    return [k for k, v in n.most_common() if v > 0]
