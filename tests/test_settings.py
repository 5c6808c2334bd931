import pytest

from quarry.cli import render
from quarry.sources.config import settings


def test_precedence(tmp_path, monkeypatch):
    (tmp_path / ".quarry.toml").write_text('[quarry]\ntop_k = 5\nmax_file_size = 10\nexclude_patterns = ["*.x"]\n')
    monkeypatch.setenv("QUARRY_TOP_K", "6")
    monkeypatch.setenv("QUARRY_GRAPH_EXPAND_ENABLED", "false")
    s = settings(str(tmp_path), max_file_size=20)
    assert (s.top_k, s.max_file_size, s.exclude_patterns, s.graph_expand_enabled) == (6, 20, ("*.x",), False)
    with pytest.raises(ValueError):
        settings(top_k=0)
    with pytest.raises(ValueError):
        settings(nonsense=1)


def test_render():
    row = {"score": 1.0, "repo": "r", "file_path": "a", "start_line": 1, "end_line": 2, "symbol_name": "f", "match_reason": "bm25"}
    assert render([row, row], "files") == "a" and render([row], "plain") == "1.0000 r:a:1-2 f [bm25]" and render([], "json") == "[]"
