"""Driver contract: entry(), queries(), oracle_sql()."""

import __spark_entry__ as E


def test_entry_runs_with_stable_schema(spark):
    df1 = E.entry(spark)
    df2 = E.entry(spark)
    assert df1.schema == df2.schema
    assert df1.count() >= 0


def test_registry_shapes():
    q = E.queries()
    o = E.oracle_sql()
    assert q and all(callable(f) for f in q.values())
    assert all(isinstance(s, str) and s.strip() for s in o.values())
