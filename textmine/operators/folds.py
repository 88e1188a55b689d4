"""Cross-validation folds (K1) and fold splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmine.operators.ranking import hashed_row_number, ntile_from_rank


def fold_hash(id_col: str, seed_col) -> F.Column:
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(":"), seed_col.cast("string")))


def assign_folds(docs: DataFrame, k=10, seed=1, repeats=1, id_col="doc_id") -> DataFrame:
    """K1: near-equal random folds, ``(doc_id, repeat, fold)``.

    Documents are ordered by md5(doc_id ':' seed + repeat - 1) and cut like
    ``ntile(k)``; the ordering is numbered by the bucketed ranker, so no
    single-partition window is planned.  Fold sizes differ by at most one."""
    if k < 2:
        raise ValueError("k must be >= 2 to cross-validate")
    base = docs.select(id_col).distinct()
    base = base.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    base = base.withColumn("_h", fold_hash(id_col, F.col("repeat") + F.lit(seed - 1)))
    ranked = hashed_row_number(base, "_h", [id_col], by=["repeat"], out="_rn")
    return ranked.select(id_col, "repeat", ntile_from_rank(F.col("_rn"), F.col("n_total"), k).alias("fold"))


def split_fold(df: DataFrame, folds: DataFrame, fold: int, repeat=1, id_col="doc_id") -> DataFrame:
    """Tag rows of ``df`` as train / test for one fold (key join)."""
    f = folds.filter(F.col("repeat") == repeat).select(id_col, "fold")
    return df.join(f, id_col).withColumn(
        "role", F.when(F.col("fold") == fold, F.lit("test")).otherwise(F.lit("train")))
