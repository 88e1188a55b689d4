"""Adapter from the driver's parquet tables to the corpus model.

* corpus  = ``documents(doc_id, text, lang, source)``
* labels  = ``labels``: class ``n`` if toxic, else ``p`` if quality, else ``o``
* markers do not occur in the data, so they are injected with plain
  replacements (`` the `` -> `` <CIT> ``, `` and ``/`` by `` -> `` <OTH> ``)

Word lists and the POS lexicon below are test parameters (not fixed values
of the studied workload): small lists of words that occur in the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEST_PREPOSITIONS = ["in", "of", "to", "for"]
TEST_SUBJECTIVE = ["is", "was", "are", "be", "this", "that", "from", "with", "at", "as"]
TEST_POS_LEXICON = [
    # word, lemma, upos
    ("is", "be", "VERB"), ("was", "be", "VERB"), ("are", "be", "VERB"), ("be", "be", "VERB"),
    ("were", "be", "VERB"), ("has", "have", "VERB"), ("have", "have", "VERB"), ("had", "have", "VERB"),
    ("this", "this", "ADJ"), ("that", "that", "ADJ"), ("other", "other", "ADJ"), ("new", "new", "ADJ"),
    ("also", "also", "ADV"), ("not", "not", "ADV"), ("then", "then", "ADV"), ("than", "than", "ADV"),
    ("there", "there", "ADV"), ("here", "here", "ADV"),
    ("the", "the", "DET"), ("of", "of", "ADP"), ("in", "in", "ADP"), ("to", "to", "ADP"),
    ("for", "for", "ADP"), ("on", "on", "ADP"), ("with", "with", "ADP"), ("from", "from", "ADP"),
    ("at", "at", "ADP"), ("as", "as", "ADP"), ("and", "and", "CCONJ"), ("or", "or", "CCONJ"),
    ("it", "it", "PRON"), ("he", "he", "PRON"), ("we", "we", "PRON"),
]

LABEL_SQL = "CASE WHEN toxic = 1 THEN 'n' WHEN quality = 1 THEN 'p' ELSE 'o' END"
INJECT_SQL = "replace(replace(replace(text, ' the ', ' <CIT> '), ' and ', ' <OTH> '), ' by ', ' <OTH> ')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", F.expr(LABEL_SQL).alias("label"))


def labelled_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a class; the join is one row per document on each side."""
    return corpus(spark, sf_dir).join(labels(spark, sf_dir), "doc_id")


def inject_markers(df: DataFrame, text_col: str = "text") -> DataFrame:
    t = F.col(text_col)
    t = F.replace(t, F.lit(" the "), F.lit(" <CIT> "))
    t = F.replace(t, F.lit(" and "), F.lit(" <OTH> "))
    t = F.replace(t, F.lit(" by "), F.lit(" <OTH> "))
    return df.withColumn(text_col, t)


def marked_corpus(spark: SparkSession, sf_dir: str, labelled: bool = False) -> DataFrame:
    base = labelled_corpus(spark, sf_dir) if labelled else corpus(spark, sf_dir)
    return inject_markers(base)


def pos_lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEST_POS_LEXICON, "word string, lemma string, upos string")
