"""Runs a query in Spark and its SQL in DuckDB over the same tables."""

from __future__ import annotations

import os

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection():
    import duckdb

    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        path = f"{SF_DIR}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def both(spark, query, sql):
    """Rows of each, columns and rows in order."""
    df = query(spark, SF_DIR)
    names = sorted(df.columns)
    found = connection().sql(sql)
    assert sorted(found.columns) == names
    place = [found.columns.index(n) for n in names]
    order = lambda row: tuple((v is None, str(v)) for v in row)
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=order), sorted((tuple(r[i] for i in place) for r in found.fetchall()), key=order)
