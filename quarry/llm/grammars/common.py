"""What the grammars share."""

from __future__ import annotations


class Bad(Exception):
    """The text is not valid."""


#: Lines whose kinds of tokens have been parsed before are not parsed again; a worker keeps so many.
KEPT = 200_000


def remember(memo: dict, key: object) -> None:
    if len(memo) >= KEPT:
        memo.clear()
    memo[key] = True
