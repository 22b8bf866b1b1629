import importlib
import sys

import __spark_entry__


def test_names_and_sql_fit():
    names = set(__spark_entry__.queries())
    assert "kv_latest" in names and set(__spark_entry__.oracle_sql()) <= names


def test_entry_runs(spark, monkeypatch):
    assert __spark_entry__.entry(spark).columns == ["key", "seq", "value"]


def test_without_the_llm_subpackage(monkeypatch):
    """With the subpackage and the pipeline taken out, the rest is still there."""

    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name.startswith("tidemark.llm") or name == "corpus_pipeline":
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    import tidemark

    for name in [n for n in sys.modules if n.startswith("tidemark.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.delattr(tidemark, "llm", raising=False)
    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    entry = importlib.reload(__spark_entry__)
    names = set(entry.queries())
    assert "kv_latest" in names and not any(n.startswith("op") or n == "pipeline" for n in names)
    assert set(entry.oracle_sql()) <= names
