"""Every registered query against its SQL twin, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from check import compare, connect
from runloom.plans import catalog


def test_every_query_has_a_twin():
    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_twin(spark, sf_dir, name):
    assert compare(spark, connect(sf_dir), name, sf_dir) is None


def test_entry_counts_examples(spark):
    rows = {r["split"]: r for r in entry.entry(spark).collect()}
    assert rows["train"]["num_examples"] > 0
    assert all(0 < r["num_response_tokens"] < r["num_tokens"] for r in rows.values())
