"""Queries against their SQL on the driver's small tables, where these are there."""

import os

import pytest

D = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(D), reason="no tables")
@pytest.mark.parametrize("name", ["strongest_edges", "community_summary", "gateways", "bursts", "rank_findings", "type_normalise", "structural_flag", "folder_rollup", "source_keys", "auc"])
def test_query_equals_sql(spark, name):
    import duckdb

    from graphloom.queries import QUERIES, SQL

    c = duckdb.connect()
    for f in os.listdir(D):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{D}/{f}'")
    df = QUERIES[name](spark, D)
    columns = sorted(df.columns)
    plain = lambda v: round(v, 5) if isinstance(v, float) else int(v) if isinstance(v, bool) else v
    got = sorted(repr([plain(r[k]) for k in columns]) for r in df.collect())
    want = c.sql(SQL[name])
    assert sorted(want.columns) == columns
    assert got == sorted(repr([plain(dict(zip(want.columns, r, strict=True))[k]) for k in columns]) for r in want.fetchall())


def test_entry_imports():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
