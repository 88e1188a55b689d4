"""Sources (A1–A6b).  Schemas are explicit; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ANNOTATION_SCHEMA = T.StructType([
    T.StructField("doc_id", T.StringType()),
    T.StructField("sid", T.IntegerType()),
    T.StructField("tid", T.IntegerType()),
    T.StructField("word", T.StringType()),
    T.StructField("lemma", T.StringType()),
    T.StructField("upos", T.StringType()),
    T.StructField("relation", T.StringType()),
    T.StructField("tid_target", T.IntegerType()),
])


def read_corpus(spark: SparkSession, path: str, schema: T.StructType | str, id_col: str | None = "ID",
                text_col: str = "Text", fmt: str = "csv", **options) -> DataFrame:
    """A1/A2: read a labelled corpus; ``text_col`` picks the text column
    (e.g. ``Dependencies`` for the pre-parsed dependency triples)."""
    reader = spark.read.schema(schema)
    if fmt == "csv":
        opts = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"'}
        opts.update(options)
        df = reader.options(**opts).csv(path)
    else:
        df = reader.format(fmt).options(**options).load(path)
    return make_corpus(df, id_col=id_col, text_col=text_col)


def make_corpus(df: DataFrame, id_col: str | None, text_col: str, keep=None) -> DataFrame:
    """A3: ``(doc_id, text, <vars>)``.  Without an id column, ids are taken
    from ``monotonically_increasing_id`` (unique, not dense, no shuffle)."""
    doc_id = F.col(id_col) if id_col else F.monotonically_increasing_id()
    others = [c for c in df.columns if c not in (id_col, text_col)] if keep is None else list(keep)
    return df.select(doc_id.alias("doc_id"), F.col(text_col).alias("text"), *others)


def read_wordlist(spark: SparkSession, path: str, col: str = "Word") -> DataFrame:
    """A4: one-column word list (``word``), de-duplicated."""
    df = spark.read.options(header="true").schema(T.StructType([T.StructField(col, T.StringType())])).csv(path)
    return df.select(F.col(col).alias("word")).where(F.col("word").isNotNull()).distinct()


def make_wordlist(spark: SparkSession, words: list[str]) -> DataFrame:
    return spark.createDataFrame([(w,) for w in words], "word string")


def make_dictionary(spark: SparkSession, dictionary: dict[str, list[str]]) -> DataFrame:
    """A5: inline dictionary -> ``(key, pattern, n_words)``."""
    rows = [(k, p, len(p.split())) for k, pats in dictionary.items() for p in pats]
    return spark.createDataFrame(rows, "key string, pattern string, n_words int")


def read_annotations(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Annotation table (one row per word) with a fixed schema."""
    if fmt == "csv":
        return spark.read.schema(ANNOTATION_SCHEMA).options(header="true").csv(path)
    return spark.read.schema(ANNOTATION_SCHEMA).parquet(path)


def lexicon_annotate(long: DataFrame, lexicon: DataFrame, term_col: str = "term",
                     sid: int = 1) -> DataFrame:
    """Stand-in annotator.  Each token gets (lemma, upos) from a lexicon
    keyed by the lower-cased word, else (word, 'X'); the head is the
    previous token of the document (``tid_target = tid - 1``, relation
    ``dep``; the first token is ``root`` with head 0).  The lexicon must be
    small (it is broadcast behind a size check)."""
    from textmine.operators.util import broadcast_if_small
    lex = broadcast_if_small(lexicon.select(F.lower("word").alias("_w"), F.col("lemma").alias("_l"),
                                            F.col("upos").alias("_u")).dropDuplicates(["_w"]))
    return (long.join(lex, F.lower(F.col(term_col)) == F.col("_w"), "left")
            .select("doc_id", F.lit(sid).alias("sid"), F.col("pos").cast("int").alias("tid"),
                    F.col(term_col).alias("word"),
                    F.coalesce("_l", term_col).alias("lemma"),
                    F.coalesce("_u", F.lit("X")).alias("upos"),
                    F.when(F.col("pos") == 1, F.lit("root")).otherwise(F.lit("dep")).alias("relation"),
                    (F.col("pos") - 1).cast("int").alias("tid_target")))


def filter_any(df: DataFrame, cols: list[str], value=1) -> DataFrame:
    """Rows where any of ``cols`` equals ``value``."""
    cond = None
    for c in cols:
        e = F.col(c) == F.lit(value)
        cond = e if cond is None else (cond | e)
    return df.filter(cond)
