"""Every registered query outside the training-data operators against its SQL."""

import os

import pytest
from oracle import same

from textloom.plans.catalog import ORACLES, QUERIES

LARGER = os.environ.get("TEST_LARGER_SF_DIR", "/root/testdata/sf0.01")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, sf_dir, name):
    same(QUERIES[name](spark, sf_dir), ORACLES[name], sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql_on_more_rows(spark, name):
    same(QUERIES[name](spark, LARGER), ORACLES[name], LARGER)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
