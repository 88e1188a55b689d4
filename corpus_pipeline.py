"""Corpus pipeline over the training-data operators.

``STAGES`` lists (name, function) pairs; each function takes (spark, docs,
sf_dir) and returns a DataFrame.  ``run`` applies them to ``documents`` one
after the other; every result is written as Parquet in the shared folder and
read again, so a lost executor costs at most one stage's tasks.

1. documents that the quality rules reject go;
2. of each group of near duplicates the document with the smallest id stays;
3. documents that hold a benchmark passage go;
4. secrets in the texts are replaced by a mark, ``n_chars`` follows the text;
5. the texts are encoded: (doc_id, n_tokens, ids), the pipeline's result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmine.llm import decontaminate, ngram_join, piece_codec, quality_rules, secret_scan
from textmine.llm.common import read_table, staged


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ledger = staged(secret_scan.scan_unseen(docs), "secret-ledger")
    return secret_scan.redact(docs, ledger).withColumn("n_chars", F.length("text").cast("long"))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_codec.encode(docs)


STAGES = [
    ("quality_rules", keep_quality),
    ("ngram_join", keep_one_of_near_copies),
    ("decontaminate", drop_benchmark),
    ("secret_scan", redact_secrets),
    ("piece_codec", encode_texts),
]

# Stages 3 and 5 have no SQL form (a fitted projection, a tokenizer's lattice);
# the tests hold the pipeline against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
