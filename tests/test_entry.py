import importlib

import pytest


@pytest.fixture(scope="module")
def entry():
    return importlib.import_module("__spark_entry__")


def test_every_sql_has_a_query(entry):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 80


def test_flagship(entry, spark):
    assert entry.entry(spark).columns == ["divergence", "majority", "n_active"]
