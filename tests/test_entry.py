"""The driver contract, with and without the corpus part."""

import __spark_entry__ as entry


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["digest", "size", "n_members"] and df.count() > 0


def test_core_stands_alone(monkeypatch):
    monkeypatch.setattr(entry.importlib.util, "find_spec", lambda name: None)
    assert not [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
