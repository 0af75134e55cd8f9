import importlib
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


def test_every_oracle_has_its_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 100


def test_entry_gives_rows(spark):
    import __spark_entry__ as entry

    if not Path(entry.SMALL).exists():
        pytest.skip("no driver tables here")
    assert entry.entry(spark).count() > 0


def test_entry_does_without_the_corpus_operators(monkeypatch):
    for name in [n for n in sys.modules if n.startswith("tabsplit.llm") or n in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "tabsplit.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    entry = importlib.import_module("__spark_entry__")
    assert entry.llm_registry is None and "settle_bill" in entry.queries() and "pipeline" not in entry.queries()
    monkeypatch.delitem(sys.modules, "__spark_entry__")


def test_nothing_else_imports_the_corpus_operators():
    for path in (ROOT / "tabsplit").rglob("*.py"):
        if "llm" not in path.parts:
            assert "tabsplit.llm" not in path.read_text() and "corpus_pipeline" not in path.read_text()
