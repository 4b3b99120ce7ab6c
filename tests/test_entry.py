"""The entry points stand without the training-data operators."""

import importlib.util

import __spark_entry__
from tandem.plans import registry


def test_core_stands_alone(monkeypatch):
    find = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name.startswith("tandem.llm") else find(name, *a))
    assert __spark_entry__.queries().keys() == registry.queries().keys()
    assert __spark_entry__.oracle_sql().keys() == registry.oracle_sql().keys()


def test_every_sql_has_a_query():
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()
