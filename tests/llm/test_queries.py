"""Registered corpus queries against their SQL, and all of them against the entry point."""

import os
import re

import pytest

import oracle
from tonefold.llm import queries

needs_data = pytest.mark.skipif(not os.path.isdir(oracle.SF_DIR), reason="no tables here")


@needs_data
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, name):
    ours, theirs = oracle.both(spark, queries.QUERIES[name], queries.SQL[name])
    assert ours == theirs and ours


def test_all_are_registered():
    import __spark_entry__

    known = __spark_entry__.queries()
    assert set(queries.QUERIES) <= set(known) and "pipeline" in known
    assert sorted(int(n[2:].split("_")[0]) for n in known if re.match("op[0-9]+_", n)) == list(range(1, 14))
