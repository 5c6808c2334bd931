"""Settings: given values over the environment over a TOML file over defaults."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, fields, replace
from pathlib import Path

from quarry.functions.search import EXCLUDES


@dataclass(frozen=True)
class Settings:
    max_file_size: int = 100_000
    top_k: int = 8
    chunk_max_chars: int = 6000
    exclude_patterns: tuple[str, ...] = tuple(EXCLUDES)
    graph_expand_enabled: bool = True
    rerank_enabled: bool = False

    def __post_init__(self) -> None:
        if self.max_file_size <= 0 or not 1 <= self.top_k <= 100 or self.chunk_max_chars <= 500:
            raise ValueError("max_file_size must be positive, top_k from 1 to 100, chunk_max_chars above 500")


def _cast(name: str, raw: object) -> object:
    kind = type(getattr(Settings(), name))
    if kind is bool:
        return raw if isinstance(raw, bool) else str(raw).strip().lower() in ("1", "true", "yes", "on")
    if kind is tuple:
        return tuple(x for x in (raw.split(",") if isinstance(raw, str) else raw) if x)
    return kind(raw)


def settings(folder: str | None = None, table: str = "quarry", prefix: str = "QUARRY_", **given: object) -> Settings:
    """The settings for a folder, whose `.quarry.toml` may have a table of them; unknown names raise."""
    names = {f.name for f in fields(Settings)}
    values: dict[str, object] = {}
    file = Path(folder) / ".quarry.toml" if folder else None
    if file and file.is_file():
        values |= tomllib.loads(file.read_text("utf-8")).get(table, {})
    values |= {n: os.environ[prefix + n.upper()] for n in names if prefix + n.upper() in os.environ}
    values |= {k: v for k, v in given.items() if v is not None}
    if unknown := set(values) - names:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return replace(Settings(), **{k: _cast(k, v) for k, v in values.items()})
