import importlib
import sys

import __spark_entry__ as entry


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_stands_alone(monkeypatch):
    """Without the optional folders the rest still imports and has its queries."""
    for name in [m for m in sys.modules if m.startswith("granary.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)

    def refuse(name, *args, _import=importlib.import_module, **kw):
        if name.startswith("granary.llm") or name == "corpus_pipeline":
            raise ImportError(name)
        return _import(name, *args, **kw)

    monkeypatch.setattr(importlib, "import_module", refuse)
    assert "flagship_revenue" in entry.queries()
    assert not any(n.startswith("op") and n[2].isdigit() for n in entry.queries())
