"""Driver contract: entry runs, every oracle names a registered query."""

import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert set(df.columns) >= {"ship_dow", "n_match", "match_rate_pct"}


def test_oracles_are_registered_queries():
    assert set(E.oracle_sql()) <= set(E.queries())
