"""Every registered query against its SQL."""

import os

import pytest

import oracle
from tonefold.jobs import catalog, measures, readings  # noqa: F401

needs_data = pytest.mark.skipif(not os.path.isdir(oracle.SF_DIR), reason="no tables here")


@needs_data
@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_matches_sql(spark, name):
    ours, theirs = oracle.both(spark, catalog.QUERIES[name], catalog.SQL[name])
    assert ours == theirs


@needs_data
@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, oracle.SF_DIR).count() > 0
