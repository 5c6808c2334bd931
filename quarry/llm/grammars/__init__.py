"""Grammars of the languages source files are checked against."""

from __future__ import annotations

import ast
import sys
import warnings

from quarry.llm.grammars import ecma, php, shell
from quarry.llm.grammars.common import Bad


def parses(text: str, lang: str) -> bool:
    """True if the text is valid in the language: python, js (as a module), ts, tsx, php or sh.

    Text of any depth is parsed: where Python's usual limit of nested calls is met, it is lifted to what a text of this
    length can need (calls between Python functions take memory, not stack). For Python the limits of its own parser hold."""
    try:
        _check(text, lang)
    except RecursionError:
        if lang == "python":
            return True  # the parser is through; only making objects of the tree went too deep
        usual = sys.getrecursionlimit()
        sys.setrecursionlimit(100 * len(text) + 10_000)
        try:
            _check(text, lang)
        except (Bad, ValueError):
            return False
        finally:
            sys.setrecursionlimit(usual)
    except (Bad, SyntaxError, ValueError, MemoryError):
        return False
    return True


def _check(text: str, lang: str) -> None:
    if lang == "python":
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text.removeprefix("\ufeff"))
    elif lang == "php":
        php.check(text)
    elif lang == "sh":
        shell.check(text)
    else:
        ecma.check(text, lang)
