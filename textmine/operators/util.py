"""Small shared helpers: bounded broadcasts, scalars, class lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Row bound under which a side whose size is not known in advance is
# broadcast explicitly.  Beyond it the plain (shuffle) join is kept and
# AQE may still switch to a broadcast from runtime statistics.
BROADCAST_MAX_ROWS = 200_000
MAX_CLASSES = 10_000
# Text of one part where cells are counted per document: some 400,000 words.
PART_CHARS = 2_500_000


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Broadcast hint only when ``df`` is proven to hold <= max_rows rows.

    The check reads at most max_rows + 1 rows; otherwise the DataFrame is
    returned unchanged and Spark picks a shuffle join.
    """
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def by_document(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars: int = PART_CHARS) -> DataFrame:
    """``df`` dealt out by document, in parts of about ``chars`` characters of text.

    What is counted per document afterwards (tokens, n-grams) stays in its part, so
    the texts are shuffled once and their many cells are not.  The number of parts is
    fixed from the text, as parts joined by their size would hold too many cells."""
    return df.repartition(document_parts(df, text_col, chars), id_col)


def document_parts(df: DataFrame, text_col: str = "text", chars: int = PART_CHARS) -> int:
    """Number of parts of about ``chars`` characters of text, one a core at least."""
    total = scalar(df.agg(F.sum(F.char_length(text_col)).alias("s")), "s") or 0
    return int(max(df.sparkSession.sparkContext.defaultParallelism, -(-total // chars)))


def scalar(df: DataFrame, col: str):
    """Value of a one-row aggregate (e.g. a document count)."""
    row = df.select(col).first()
    return None if row is None else row[0]


def class_values(labels: DataFrame, col: str = "label") -> list:
    """Sorted distinct class values (bounded metadata, like a label indexer)."""
    vals = [r[0] for r in labels.select(col).distinct().limit(MAX_CLASSES + 1).collect()]
    if len(vals) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes in column {col}")
    return sorted(v for v in vals if v is not None)


def safe_ln(x):
    """ln(x) with ln(0) = -inf (Spark's ln gives NULL for 0)."""
    return F.when(x > 0, F.log(x)).otherwise(F.lit(float("-inf")))
