"""Driver contract: entry runs, every query has a name and schema."""

import __spark_entry__ as entry


def test_entry_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and set(df.columns) >= {"precision", "recall", "f1", "mrr", "topk_accuracy"}


def test_oracles_cover_queries():
    from quarry.plans.oracle import ORACLE_SQL
    from quarry.plans.queries import QUERIES

    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and set(QUERIES) <= set(q)
    assert set(QUERIES) == set(ORACLE_SQL)
    assert len(QUERIES) >= 43
