"""The driver contract, with and without the training-data subpackage."""

import importlib.util
import sys

import __spark_entry__ as entry


def test_entry_and_names(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.schema == entry.entry(spark).schema
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and len(q) > 90


def test_core_stands_alone(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("skeinworks.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "skeinworks.llm", None)
    assert "edge_dedup" in entry.queries() and "p2_found" not in entry.queries()
    assert importlib.util.find_spec("skeinworks.plans.catalogue")
