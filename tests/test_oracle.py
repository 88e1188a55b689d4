"""Every registered query with a DuckDB twin returns the same rows (sf0.001)."""

import pytest

import __spark_entry__ as E
from textmine.plans.compare import digest

from conftest import SF_SMALL

ORACLE = E.oracle_sql()
QUERIES = E.queries()


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_duckdb(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    rel = duck.execute(ORACLE[name])
    dcols = [d[0] for d in rel.description]
    drows = rel.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    hs, ls = digest(df.columns, srows)
    hd, ld = digest(dcols, drows)
    if hs != hd:
        only_s = sorted(set(ls) - set(ld))[:5]
        only_d = sorted(set(ld) - set(ls))[:5]
        pytest.fail(f"value mismatch\n spark-only: {only_s}\n duck-only: {only_d}")
