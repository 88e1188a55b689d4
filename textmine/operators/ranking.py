"""Exact, distributed row numbering without a single-partition window.

A global ``row_number() over (order by k)`` makes Spark move every row to one
task.  Here the order key is an md5 hex string, so its first ``prefix``
hex digits split rows into ``16**prefix`` ordered buckets of near-equal
size.  Bucket sizes (a table of at most 4096 rows per partition group) give
exact offsets; the number inside a bucket comes from a window partitioned
by the bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hashed_row_number(df: DataFrame, hash_col: str, tie_cols=(), by=(), out="rn",
                      prefix: int = 3) -> DataFrame:
    """1-based row number ordered by (hash_col, *tie_cols) within ``by``.

    Adds ``out`` and ``n_total`` (group size).  ``hash_col`` must be a hex
    string of a uniform hash (e.g. ``md5``)."""
    by = list(by)
    keyed = df.withColumn("_bucket", F.conv(F.substring(hash_col, 1, prefix), 16, 10).cast("int"))
    sizes = keyed.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    w_prev = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    w_all = Window.partitionBy(*by)
    offsets = sizes.select(*by, "_bucket",
                           F.coalesce(F.sum("_size").over(w_prev), F.lit(0)).alias("_offset"),
                           F.sum("_size").over(w_all).alias("n_total"))
    # bounded: at most 16**prefix rows per group of ``by``
    ranked = keyed.join(F.broadcast(offsets), [*by, "_bucket"])
    w_in = Window.partitionBy(*by, "_bucket").orderBy(hash_col, *tie_cols)
    return ranked.withColumn(out, F.row_number().over(w_in) + F.col("_offset")).drop("_bucket", "_offset")


def ntile_from_rank(rn, n, k: int):
    """``ntile(k)`` for 1-based rank ``rn`` of ``n`` rows: the first n % k
    tiles hold one row more."""
    q = F.floor(n / k)
    r = n - q * k
    big = r * (q + 1)
    return F.when(rn <= big, F.floor((rn - 1) / (q + 1)) + 1) \
            .otherwise(r + F.floor((rn - big - 1) / F.greatest(q, F.lit(1))) + 1).cast("int")
