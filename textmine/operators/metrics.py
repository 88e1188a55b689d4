"""Evaluation (K11–K15, AG4–AG5, AG7).

Predictions: ``(<keys>, doc_id, actual, predicted)``.  Division by zero
gives NULL (``try_divide``) standing for NaN; ``nan_policy`` decides how
NaN enters the fold summaries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmine.functions.text import array_lit


def confusion(pred: DataFrame, classes: list, keys=("fold",)) -> DataFrame:
    """K11/AG4: counts on the full actual x predicted class grid per key."""
    keys = list(keys)
    counts = pred.groupBy(*keys, "actual", "predicted").agg(F.count(F.lit(1)).alias("n"))
    grid = (pred.select(*keys).distinct()
            .withColumn("actual", F.explode(array_lit(classes)))
            .withColumn("predicted", F.explode(array_lit(classes))))
    return (grid.join(counts, [*keys, "actual", "predicted"], "left")
            .withColumn("n", F.coalesce("n", F.lit(0)).cast("long")))


def class_metrics(conf: DataFrame, keys=("fold",)) -> DataFrame:
    """Per class precision, recall, F1 (NULL = NaN) and support."""
    keys = list(keys)
    by_pred = conf.groupBy(*keys, F.col("predicted").alias("label")).agg(
        F.sum("n").alias("n_predicted"))
    by_act = conf.groupBy(*keys, F.col("actual").alias("label")).agg(
        F.sum("n").alias("support"),
        F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)).alias("tp"))
    m = by_act.join(by_pred, [*keys, "label"])
    p = F.try_divide(F.col("tp").cast("double"), F.col("n_predicted").cast("double"))
    r = F.try_divide(F.col("tp").cast("double"), F.col("support").cast("double"))
    m = m.withColumn("precision", p).withColumn("recall", r)
    f1 = F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return m.withColumn("f1", f1)


def fold_metrics(cm: DataFrame, keys=("fold",), nan_policy="fold_zero") -> DataFrame:
    """Macro, micro and support-weighted F1 per key.

    fold_zero: a NaN class F1 makes the fold's macro NaN, then 0.
    class_zero: NaN class F1 counts as 0.  The weighted mean skips classes
    of zero support; micro F1 equals accuracy on the square grid."""
    keys = list(keys)
    f1 = F.col("f1")
    if nan_policy == "class_zero":
        f1 = F.coalesce(f1, F.lit(0.0))
    elif nan_policy != "fold_zero":
        raise ValueError("nan_policy must be 'fold_zero' or 'class_zero'")
    w = F.col("support").cast("double")
    agg = cm.withColumn("_f1", f1).groupBy(*keys).agg(
        F.when(F.count("_f1") == F.count(F.lit(1)), F.avg("_f1")).alias("_macro"),
        F.sum("tp").alias("_tp"), F.sum("support").alias("_n"), F.sum("n_predicted").alias("_np"),
        F.when(F.count(F.when((w > 0) & F.col("_f1").isNull(), 1)) == 0,
               F.try_divide(F.sum(F.when(w > 0, F.col("_f1") * w)), F.sum(w))).alias("_weighted"))
    p_tot = F.try_divide(F.col("_tp").cast("double"), F.col("_np").cast("double"))
    r_tot = F.try_divide(F.col("_tp").cast("double"), F.col("_n").cast("double"))
    micro = F.try_divide(2 * p_tot * r_tot, p_tot + r_tot)
    return agg.select(*keys,
                      F.coalesce("_macro", F.lit(0.0)).alias("macro_f1"),
                      F.coalesce(micro, F.lit(0.0)).alias("micro_f1"),
                      F.coalesce("_weighted", F.lit(0.0)).alias("weighted_f1"))


def cv_summary(fm: DataFrame, keys=()) -> DataFrame:
    """Mean of the fold metrics per key (e.g. repeat, smoothing)."""
    return fm.groupBy(*keys).agg(F.avg("macro_f1").alias("macro_f1"),
                                 F.avg("micro_f1").alias("micro_f1"),
                                 F.avg("weighted_f1").alias("weighted_f1"),
                                 F.count(F.lit(1)).alias("n_folds"))


def repeat_summary(summary: DataFrame, keys=(), metric="macro_f1") -> DataFrame:
    """AG7: mean and standard error over repeats."""
    return summary.groupBy(*keys).agg(
        F.avg(metric).alias("mean"),
        (F.stddev_samp(metric) / F.sqrt(F.count(F.lit(1)))).alias("se"),
        F.count(F.lit(1)).alias("n_repeats"))
