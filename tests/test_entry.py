"""Contract of the entry module."""

import __spark_entry__ as entry


def test_flagship_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["metric", "median", "error_pct"] and df.count() == 3


def test_every_check_belongs_to_a_query():
    queries, checks = entry.queries(), entry.oracle_sql()
    assert set(checks) <= set(queries) and len(queries) > 150
    assert all(callable(f) for f in queries.values())
