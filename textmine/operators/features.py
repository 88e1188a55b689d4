"""Document-feature tables.

Long form ``(doc_id, [label,] feature, n|weight)``; zero cells are absent.
Labels are attached at the document level (one row per document) and then
carried along, so no per-token row is ever joined by ``doc_id``.
"""

from __future__ import annotations

import functools
import operator

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmine.functions.text import glob_to_regex, is_glob
from textmine.operators.util import broadcast_if_small, scalar
from textmine.session import WINDOW_GROUP_LIMIT

# Buckets of features whose sums bound those of their features: few enough for every task and for the driver.
BUCKETS = 1 << 17


def _ensure_group_limit(spark, k: int):
    """Keep per-group top-k planned as a partial WindowGroupLimit."""
    cur = int(spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if k is not None and k > cur:
        spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", str(max(k, WINDOW_GROUP_LIMIT)))


# ------------------------------------------------------------------ D1
def dfm(long: DataFrame, by=("doc_id",), term_col="term", lower=True, out="n") -> DataFrame:
    """Count features per document (lower-cased)."""
    feat = F.lower(F.col(term_col)) if lower else F.col(term_col)
    return long.groupBy(*by, feat.alias("feature")).agg(F.count(F.lit(1)).alias(out))


# ------------------------------------------------------------------ D2
def tf_log(n: Column) -> Column:
    return F.lit(1.0) + F.log10(n.cast("double"))


def idf_inverse(n_docs, docfreq: Column) -> Column:
    return F.log10(F.lit(float(n_docs)) / docfreq.cast("double"))


def document_count(d: DataFrame, id_col="doc_id") -> int:
    return scalar(d.agg(F.countDistinct(id_col).alias("n")), "n")


def tfidf(counts: DataFrame, n_docs: int | None = None, id_col="doc_id", value_col="n",
          out="weight", selected=False) -> DataFrame:
    """weight = (1 + log10 n) * log10(N / df).

    The document frequency table (one row per feature) is joined back on
    ``feature`` by a hash of that table, so the cells are not sorted; frequent
    features are skewed keys, which AQE's skew-join splitting handles (the small
    side is one row per key).  ``selected``: the features are a vocabulary's, so
    that table is counted and sent to the cells."""
    n_docs = n_docs if n_docs is not None else document_count(counts, id_col)
    docfreq = counts.groupBy("feature").agg(F.count(F.lit(1)).alias("docfreq"))
    if selected:
        docfreq = broadcast_if_small(docfreq.persist(StorageLevel.MEMORY_AND_DISK))
    else:
        docfreq = docfreq.hint("shuffle_hash")
    return (counts.join(docfreq, "feature")
            .withColumn(out, tf_log(F.col(value_col)) * idf_inverse(n_docs, F.col("docfreq")))
            .drop("docfreq"))


def tfidf_class_frequency(counts: DataFrame, n_docs: int | None = None, group_col="label",
                          id_col="doc_id", value_col="n", classes: list | None = None) -> DataFrame:
    """Sum of tf-idf per (class, feature) without joining per-document rows:
    sum_d tf(d,w) * idf(w) = idf(w) * sum_d tf(d,w).  Both sums are partial
    aggregates.  With ``classes`` named, the classes' sums stand side by side and
    one aggregate by feature gives both; else two per-feature tables are joined."""
    n_docs = n_docs if n_docs is not None else document_count(counts, id_col)
    if classes:
        # A class without the feature has no sum (null) and no row.
        sums = counts.groupBy("feature").agg(F.count(F.lit(1)).alias("_df"), *[
            F.sum(F.when(F.col(group_col) == F.lit(c), tf_log(F.col(value_col)))).alias(f"_tf{i}") for i, c in enumerate(classes)])
        cells = F.array(*[F.struct(F.lit(c).alias(group_col), (F.col(f"_tf{i}") * idf_inverse(n_docs, F.col("_df"))).alias("frequency"))
                          for i, c in enumerate(classes)])
        return sums.select("feature", F.explode(cells).alias("_c")).select(f"_c.{group_col}", "feature", "_c.frequency").filter(
            "frequency is not null")
    tf_sum = counts.groupBy(group_col, "feature").agg(F.sum(tf_log(F.col(value_col))).alias("_tf"))
    docfreq = counts.groupBy("feature").agg(F.count(F.lit(1)).alias("docfreq"))
    return (tf_sum.join(docfreq, "feature")
            .select(group_col, "feature", (F.col("_tf") * idf_inverse(n_docs, F.col("docfreq"))).alias("frequency")))


def reachable_class_frequency(counts: DataFrame, n_docs: int, k: int, classes: list, group_col="label", value_col="n",
                              digits=6, buckets: int = BUCKETS) -> DataFrame:
    """``tfidf_class_frequency`` of the features that may be among a class's top k (ties kept): all of those, few others.

    Most features (rare n-grams) are far below the k-th value, so their strings are not
    shuffled.  Features are dealt by hash into ``buckets``, whose class sums bound those of
    each of their features: with tf <= s and every cell's tf <= m, df is at least tf / m and
    tf log10(N / df) at most tf log10(N m / tf), which rises up to tf = N m / e.  The buckets
    with the highest bounds are counted by feature; their k-th value is one that the k-th of
    all features cannot be below, and buckets that do not reach it hold none of the top k."""
    bucket = F.pmod(F.xxhash64("feature"), F.lit(buckets)).cast("int")
    sums = counts.groupBy(bucket.alias("_b")).agg(F.max(tf_log(F.col(value_col))).alias("m"), *[
        F.sum(F.when(F.col(group_col) == F.lit(c), tf_log(F.col(value_col)))).alias(f"s{i}") for i, c in enumerate(classes)])
    held = sums.collect()  # at most one row a bucket
    at = np.array([r["_b"] for r in held], dtype=int)
    most = np.array([[r["m"]] for r in held], dtype=float).reshape(-1, 1) * max(n_docs, 1)
    tf = np.array([[r[f"s{i}"] for i in range(len(classes))] for r in held], dtype=float).reshape(-1, len(classes))
    tf = np.minimum(tf, most / np.e)
    bound = np.nan_to_num(tf * np.log10(most / tf), nan=-np.inf)  # no cell of the class in the bucket

    def counted(chosen: np.ndarray) -> DataFrame:
        own = counts.sparkSession.createDataFrame([(int(b),) for b in at[chosen]], "_b int")
        return tfidf_class_frequency(counts.join(F.broadcast(own), bucket == own["_b"], "left_semi"), n_docs, group_col,
                                     value_col=value_col, classes=classes)

    first = np.zeros(len(at), dtype=bool)
    for i in range(len(classes)):
        first[np.argsort(-bound[:, i])[:2 * k]] = True
    if first.all():
        return tfidf_class_frequency(counts, n_docs, group_col, value_col=value_col, classes=classes)
    freq = counted(first).persist(StorageLevel.MEMORY_AND_DISK)
    kth = {r[group_col]: r["_kth"] for r in kth_values(freq, [group_col], k, digits=digits).collect()}
    # Beyond the rounding of values and of sums in another order.
    low = np.array([kth[c] - 1e-5 - 1e-9 * abs(kth[c]) if c in kth else -np.inf for c in classes])
    needed = ((bound >= low) & (bound > -np.inf)).any(axis=1)
    if not (needed & ~first).any():
        return freq
    freq.unpersist()
    return counted(needed).persist(StorageLevel.MEMORY_AND_DISK)  # read three times by the ranking


# ------------------------------------------------------------------ D3
def weight_boolean(d: DataFrame, value_col="n") -> DataFrame:
    return d.withColumn(value_col, F.when(F.col(value_col) > 0, F.lit(1)).otherwise(F.lit(0)).cast("long"))


# ------------------------------------------------------------------ D4
def dictionary_table(spark, dictionary: dict[str, list[str]]) -> DataFrame:
    """A5: key -> pattern rows (bounded: built from a Python literal)."""
    rows = [(k, p) for k, pats in dictionary.items() for p in pats]
    return spark.createDataFrame(rows, "key string, pattern string")


def dfm_lookup(counts: DataFrame, dictionary: dict[str, list[str]], by=("doc_id",),
               value_col="n", case_insensitive=True) -> DataFrame:
    """Per document, summed counts of features matching each key's
    patterns (globs allowed).  A feature counts once per key even if several
    of the key's patterns match it."""
    keys = [F.when(test, F.lit(key)) for key, test in dictionary_tests(F.col("feature"), dictionary, case_insensitive).items()]
    found = F.filter(F.array(*keys), lambda k: k.isNotNull()) if keys else F.array().cast("array<string>")
    res = counts.select(*by, "feature", value_col, F.explode(found).alias("key"))
    res = res.dropDuplicates([*by, "key", "feature"])
    return res.groupBy(*by, F.col("key").alias("feature")).agg(F.sum(value_col).alias(value_col))


def dictionary_tests(feature: Column, dictionary: dict[str, list[str]], case_insensitive=True) -> dict[str, Column]:
    """For every key with patterns whether ``feature`` matches one of them."""
    feat = F.lower(feature) if case_insensitive else feature
    keys = {}
    for key, pats in dictionary.items():  # one pass for all keys: the dictionary is a parameter
        pats = [p.lower() if case_insensitive else p for p in pats]
        tests = [feat.rlike("|".join(f"(?:{glob_to_regex(p)})" for p in pats if is_glob(p)))] if any(map(is_glob, pats)) else []
        exact = [p for p in pats if not is_glob(p)]
        if exact:
            tests.append(feat.isin(exact))
        if tests:
            keys[key] = functools.reduce(operator.or_, tests)
    return keys


# ------------------------------------------------------------------ D5
def dfm_group(d: DataFrame, group_col="label", value_col="n") -> DataFrame:
    """Collapse documents to groups."""
    return d.groupBy(group_col, "feature").agg(F.sum(value_col).alias(value_col))


# ------------------------------------------------------------------ D6
def frequency(d: DataFrame, group_col="label", value_col="n", id_col="doc_id") -> DataFrame:
    """Per (group, feature): summed value and document frequency."""
    return d.groupBy(group_col, "feature").agg(
        F.sum(value_col).alias("frequency"), F.count(F.lit(1)).alias("docfreq"))


def rank_within(freq: DataFrame, group_col="label", n: int | None = None, ties="min", seed=1,
                value_col="frequency", digits=6) -> DataFrame:
    """D6 ranking: ``rank`` (min ties) or ``row_number`` with a seeded
    pseudo-random tie order, within each group, optionally top ``n``.

    Values are compared after rounding to ``digits`` so float summation
    order cannot break ties differently between runs.  With ``n`` the filter
    is planned as a partial WindowGroupLimit before the shuffle, so each
    group's task receives at most n rows per upstream partition."""
    key = F.round(F.col(value_col), digits) if digits is not None else F.col(value_col)
    if ties == "min":
        w = Window.partitionBy(group_col).orderBy(key.desc())
        fn = F.rank()
    elif ties == "random":
        w = Window.partitionBy(group_col).orderBy(key.desc(), F.md5(F.concat_ws(":", F.col("feature"), F.lit(str(seed)))))
        fn = F.row_number()
    else:
        raise ValueError("ties must be 'min' or 'random'")
    res = freq.withColumn("rank", fn.over(w))
    if n is not None:
        _ensure_group_limit(freq.sparkSession, n)
        res = res.filter(F.col("rank") <= n)
    return res


# ---------------------------------------------------- k-th value of a group
def _bin(value: Column) -> Column:
    """Bin number that does not fall as the value rises: 64 bins for each power of two, mirrored below zero."""
    size = F.floor(F.log2(F.abs(value)) * 64).cast("long") + 100_000
    return F.when(value > 0, size).when(value < 0, -size).otherwise(F.lit(0).cast("long"))


def _first_reaching(counts: DataFrame, by: list[str], order: Column, k: Column) -> DataFrame:
    """Of each group's counted cells in ``order`` the first at which the running count reaches ``k``; adds ``_before``."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    run = counts.withColumn("_upto", F.sum("_c").over(w)).withColumn("_before", F.col("_upto") - F.col("_c"))
    return run.filter((F.col("_upto") >= k) & (F.col("_before") < k)).drop("_upto", "_c")


def kth_values(freq: DataFrame, by: list[str], k: int, value_col="frequency", digits=6) -> DataFrame:
    """(by, ``_kth``, ``_above``): every group's k-th largest rounded value and how many values lie above it.

    Groups with fewer than k rows have no row.  Rows are counted by bins of their
    value, then, within the bin that holds the k-th, by value: partial aggregates,
    so no task receives a group's rows, and windows run over the counts only.
    """
    v = F.round(F.col(value_col), digits) if digits is not None else F.col(value_col)
    cells = freq.select(*by, v.alias("_v")).withColumn("_b", _bin(F.col("_v")))
    bins = _first_reaching(cells.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_c")), by, F.col("_b").desc(), F.lit(k))
    bins = bins.withColumnRenamed("_before", "_skip")
    # One row a group: small beside the cells, but its size is not known here, so the join is left to the planner.
    near = cells.join(bins, [*by, "_b"]).groupBy(*by, "_v", "_skip").agg(F.count(F.lit(1)).alias("_c"))
    found = _first_reaching(near, by, F.col("_v").desc(), F.lit(k) - F.col("_skip"))
    return found.select(*by, F.col("_v").alias("_kth"), (F.col("_skip") + F.col("_before")).alias("_above"))


def top_k(freq: DataFrame, by: list[str], k: int, value_col="frequency", ties="min", seed=1, digits=6,
          short_class="keep") -> DataFrame:
    """Rows of each group with ``rank() <= k`` (``ties='min'``), or the first k with ties in seeded order (``'random'``).

    short_class='drop' leaves out groups with fewer than k rows."""
    if ties not in ("min", "random"):
        raise ValueError("ties must be 'min' or 'random'")
    if short_class not in ("keep", "drop"):
        raise ValueError("short_class must be 'keep' or 'drop'")
    kth = kth_values(freq, by, k, value_col, digits)
    v = F.round(F.col(value_col), digits) if digits is not None else F.col(value_col)
    # The group alone is the join's key, so its few rows must reach all tasks: one row a class (and fold).
    rows = freq.join(F.broadcast(kth), by, "inner" if short_class == "drop" else "left")
    if ties == "min":
        return rows.filter(F.coalesce(v >= F.col("_kth"), F.lit(True))).drop("_kth", "_above")
    above = rows.filter(F.coalesce(v > F.col("_kth"), F.lit(True))).drop("_kth", "_above")
    # Of the rows equal to the k-th value the first by md5, found in the same way: by bins of the hash, then the hash.
    tied = rows.filter(v == F.col("_kth")).withColumn("_h", F.md5(F.concat_ws(":", F.col("feature"), F.lit(str(seed)))))
    tied = tied.withColumn("_b", F.conv(F.substring("_h", 1, 3), 16, 10).cast("long"))
    left = F.lit(k) - F.col("_above")
    w = Window.partitionBy(*by, "_above").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    bins = tied.groupBy(*by, "_above", "_b").agg(F.count(F.lit(1)).alias("_c")).withColumn("_upto", F.sum("_c").over(w))
    bins = bins.select(*by, "_b", (F.col("_upto") - F.col("_c")).alias("_skip"), "_upto")
    tied = tied.join(bins, [*by, "_b"]).filter(F.col("_skip") < left)
    whole = tied.filter(F.col("_upto") <= left)
    w = Window.partitionBy(*by, "_b").orderBy("_h")
    part = tied.filter(F.col("_upto") > left).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") + F.col("_skip") <= left)
    return above.unionByName(whole.select(*freq.columns)).unionByName(part.select(*freq.columns))


# ------------------------------------------------------------------ D7
def dictionary_builder(freq: DataFrame, k=1000, short_class="keep", group_col="label") -> DataFrame:
    """Union over classes of the features whose class frequency is at
    least the k-th ranked one (ties kept) == ``rank() <= k``.

    short_class='drop' reproduces the studied behaviour where a class with
    fewer than k features contributes nothing; 'keep' keeps all of them."""
    return top_k(freq, [group_col], k, short_class=short_class).select("feature").distinct()


# ------------------------------------------------------------------ D8/D9
def top_features(d: DataFrame, group_col="label", value_col="n", k=1000, ties="min", seed=1) -> DataFrame:
    """D8 (min ties, rank <= k) / D9 (random ties, first k): distinct features."""
    # The ranking reads the frequencies several times; the cells behind them are made once.
    freq = frequency(d, group_col, value_col).persist(StorageLevel.MEMORY_AND_DISK)
    return top_k(freq, [group_col], k, ties=ties, seed=seed).select("feature").distinct()


# ------------------------------------------------------------------ D10/D12
def select_features(d: DataFrame, vocab: DataFrame, vocab_col="feature") -> DataFrame:
    """Keep features of a vocabulary (semi join).  A vocabulary that is
    counted to be small is broadcast from the start: left to runtime sizes, the
    cells would have been shuffled by then.  It is read twice, so callers keep it."""
    v = broadcast_if_small(vocab.select(F.col(vocab_col).alias("feature")).distinct())
    return d.join(v, "feature", "left_semi")


align = select_features  # D12


# ------------------------------------------------------------------ D11
def combine(*dfms: DataFrame, by=("doc_id",), value_col="n") -> DataFrame:
    """Stack feature tables and sum cells with the same key."""
    res = dfms[0].select(*by, "feature", value_col)
    for d in dfms[1:]:
        res = res.unionByName(d.select(*by, "feature", value_col))
    return res.groupBy(*by, "feature").agg(F.sum(value_col).alias(value_col))


# ------------------------------------------------------------------ D13
def columns_to_dfm(df: DataFrame, cols: list[str], by=("doc_id",), value_col="n") -> DataFrame:
    """Numeric columns -> long features, zero cells dropped."""
    # Not by unpivot: a kept table over one is not found again where a plan joins it with itself, and is made anew there.
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias(value_col)) for c in cols])
    long = df.select(*by, F.explode(cells).alias("_c")).select(*by, "_c.feature", f"_c.{value_col}")
    return long.filter(F.col(value_col) != 0)


# ------------------------------------------------------------------ D15
def with_labels(d: DataFrame, labels: DataFrame, id_col="doc_id", how="inner") -> DataFrame:
    """Attach labels by key (never by position)."""
    return d.join(labels, id_col, how)


# ------------------------------------------------------------------ D16
def keyness(grouped: DataFrame, target, group_col="label", value_col="n", measure="chi2") -> DataFrame:
    """Keyness of each feature for ``target`` vs the other groups.

    chi2 with Yates correction, signed negative when the target count is
    below expectation; pmi = ln(a / E) for a > 0."""
    is_t = F.col(group_col) == F.lit(target)
    per = grouped.groupBy("feature").agg(
        F.sum(F.when(is_t, F.col(value_col)).otherwise(0)).cast("double").alias("n_target"),
        F.sum(F.when(~is_t, F.col(value_col)).otherwise(0)).cast("double").alias("n_reference"))
    tot = grouped.agg(F.sum(F.when(is_t, F.col(value_col)).otherwise(0)).cast("double").alias("t"),
                      F.sum(F.when(~is_t, F.col(value_col)).otherwise(0)).cast("double").alias("r")).first()
    t_all, r_all = float(tot["t"] or 0.0), float(tot["r"] or 0.0)
    a, b = F.col("n_target"), F.col("n_reference")
    c, dd = F.lit(t_all) - a, F.lit(r_all) - b
    n = a + b + c + dd
    e = F.try_divide((a + b) * (a + c), n)
    if measure == "chi2":
        num = n * F.pow(F.greatest(F.lit(0.0), F.abs(a * dd - b * c) - n / 2), 2)
        den = (a + b) * (c + dd) * (a + c) * (b + dd)
        stat = F.try_divide(num, den)
        stat = F.when(a < e, -stat).otherwise(stat)
    elif measure == "pmi":
        stat = F.when(a > 0, F.log(F.try_divide(a, e)))
    else:
        raise ValueError("measure must be 'chi2' or 'pmi'")
    return per.withColumn(measure, stat)


# ------------------------------------------------------------------ D17
def top_n(df: DataFrame, by: str, n=10, per: str | None = None, desc=True, tie_col="feature",
          digits=6) -> DataFrame:
    """First n rows by ``by`` (per group when ``per``); ties by tie_col."""
    key = F.round(F.col(by), digits) if digits is not None else F.col(by)
    key = key.desc() if desc else key.asc()
    w = Window.partitionBy(per) if per else Window.partitionBy()
    if per is None:
        return df.orderBy(key, F.col(tie_col)).limit(n)
    _ensure_group_limit(df.sparkSession, n)
    return df.withColumn("rank", F.row_number().over(w.orderBy(key, F.col(tie_col)))).filter(F.col("rank") <= n)


# ------------------------------------------------------------------ D14
def vocabulary_index(vocab: DataFrame, vocab_col="feature") -> DataFrame:
    """Feature -> 0-based column index, numbered without a global window."""
    from textmine.operators.ranking import hashed_row_number
    v = vocab.select(F.col(vocab_col).alias("feature")).distinct().withColumn("_h", F.md5("feature"))
    return hashed_row_number(v, "_h", ["feature"], out="idx").select(
        "feature", (F.col("idx") - 1).cast("int").alias("idx"), F.col("n_total").cast("int").alias("size"))
