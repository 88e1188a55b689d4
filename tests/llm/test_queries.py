"""Every registered query against its DuckDB twin, and the registration itself."""

import re

import pytest

import corpus_pipeline
from textmine.llm.catalog import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(str(r[i]) for i in order) for r in rows))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    found = duck.execute(ORACLE[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(columns, found.fetchall())


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES if n.startswith("op")) == list(range(1, 14))
    assert "pipeline" in QUERIES
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_join", "decontaminate", "secret_scan", "piece_codec"]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - {"pipeline"}))
def test_query_without_sql_covers_its_table(spark, name):
    df = QUERIES[name](spark, SF)
    table = "conversations" if name.startswith("op4") else "documents"
    n = spark.read.parquet(f"{SF}/{table}.parquet").count()
    if not name.startswith("op6"):  # reports contaminated rows only
        assert df.count() == n
