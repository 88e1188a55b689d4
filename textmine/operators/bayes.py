"""Multinomial Naive Bayes (K2–K5).

prior(c) = documents of c / documents ("docfreq" prior);
P(w|c)   = (n_wc + s) / (sum_w n_wc + s V), V = size of the whole feature set;
score(d,c) = ln prior(c) + sum_w n_dw ln P(w|c);  arg-max, ties to the
higher prior and then to the first class.

Inputs are long tables: ``counts(doc_id, label, feature, n)`` (label carried
from the document level) and ``docs(doc_id, label)`` (all labelled
documents, also those without a selected feature).
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textmine.functions.text import array_lit
from textmine.operators.features import tf_log, top_k
from textmine.operators.util import broadcast_if_small, class_values, safe_ln, scalar

# Model entries (features x folds of all repeats) up to which a model is broadcast: some 80 MB.
MODEL_ENTRIES = 1_500_000


def _prior(docs: DataFrame) -> DataFrame:
    per = docs.groupBy("label").agg(F.count(F.lit(1)).alias("n_docs"))
    # at most one row per class
    return per.withColumn("prior", F.col("n_docs") / F.sum("n_docs").over(Window.partitionBy()))


def nb_fit(counts: DataFrame, docs: DataFrame, smoothing=1.0, classes=None) -> DataFrame:
    """K2: model ``(label, feature, n_wc, p_wgc, prior)`` on the full
    class x feature grid."""
    classes = classes or class_values(docs)
    v = scalar(counts.agg(F.countDistinct("feature").alias("v")), "v")
    nwc = counts.groupBy("label", "feature").agg(F.sum("n").alias("n_wc"))
    grid = counts.select("feature").distinct().withColumn("label", F.explode(array_lit(classes)))
    tot = nwc.groupBy("label").agg(F.sum("n_wc").alias("t_c"))
    prior = _prior(docs)
    m = (grid.join(nwc, ["label", "feature"], "left")
         .withColumn("n_wc", F.coalesce("n_wc", F.lit(0)))
         .join(F.broadcast(tot), "label", "left")        # one row per class
         .join(F.broadcast(prior.select("label", "prior")), "label", "left"))
    s = float(smoothing)
    p = (F.col("n_wc") + s) / (F.coalesce("t_c", F.lit(0)) + s * v)
    return m.select("label", "feature", "n_wc", p.alias("p_wgc"), F.coalesce("prior", F.lit(0.0)).alias("prior"))


def nb_posterior(model: DataFrame) -> DataFrame:
    """K4: P(c|w) = P(w|c) prior(c) / sum_c' P(w|c') prior(c').  The window
    is per feature and holds one row per class."""
    joint = F.col("p_wgc") * F.col("prior")
    return model.withColumn("p_cgw", F.try_divide(joint, F.sum(joint).over(Window.partitionBy("feature"))))


def _argmax(score_cols, prior_cols, classes):
    """Class with the highest rounded score, then higher prior, then first."""
    cands = [F.struct(F.round(sc, 6).alias("s"), pc.alias("p"), F.lit(-i).alias("o"), F.lit(c).alias("c"))
             for i, (sc, pc, c) in enumerate(zip(score_cols, prior_cols, classes))]
    return F.greatest(*cands)["c"] if len(cands) > 1 else cands[0]["c"]


def nb_predict(counts: DataFrame, docs: DataFrame, model: DataFrame, classes=None) -> DataFrame:
    """K3: predicted class per document of ``docs`` (documents without a
    model feature get the prior only)."""
    classes = classes or sorted(r[0] for r in model.select("label").distinct().collect())
    wide = model.groupBy("feature").agg(
        *[F.max(F.when(F.col("label") == c, safe_ln(F.col("p_wgc")))).alias(f"lp_{i}") for i, c in enumerate(classes)])
    priors = model.groupBy().agg(
        *[F.max(F.when(F.col("label") == c, F.col("prior"))).alias(f"pr_{i}") for i, c in enumerate(classes)])
    # Few rows, one a feature: sent to the cells, which stay where their document is.
    wide = broadcast_if_small(wide.persist(StorageLevel.MEMORY_AND_DISK))
    sums = (counts.select("doc_id", "feature", "n").join(wide, "feature")
            .groupBy("doc_id").agg(*[F.sum(F.col("n") * F.col(f"lp_{i}")).alias(f"s_{i}") for i in range(len(classes))]))
    pr = priors.first()
    out = docs.select("doc_id", F.col("label").alias("actual")).join(sums, "doc_id", "left")
    scores = [safe_ln(F.lit(float(pr[f"pr_{i}"] or 0.0))) + F.coalesce(F.col(f"s_{i}"), F.lit(0.0))
              for i in range(len(classes))]
    return out.select("doc_id", "actual", _argmax(scores, [F.lit(float(pr[f"pr_{i}"] or 0.0)) for i in range(len(classes))],
                                                  classes).alias("predicted"))


def _placed(folds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, _slots)``, a document's (repeat, fold, slot) entries, and ``(repeat, fold, slot)``, the
    numbered folds: repeats x folds rows."""
    keys = sorted(tuple(r) for r in folds.select("repeat", "fold").distinct().collect())
    slots = folds.sparkSession.createDataFrame([(*key, i) for i, key in enumerate(keys)], "repeat int, fold int, slot int")
    placed = folds.join(F.broadcast(slots), ["repeat", "fold"]).groupBy("doc_id").agg(
        F.collect_list(F.struct("repeat", "fold", "slot")).alias("_slots"))
    return placed, slots


def _log_sums(with_slots: DataFrame, trained: DataFrame, smoothings, n_classes: int) -> DataFrame:
    """``(doc_id, repeat, fold, dlen, sl<smoothing>_<class>)``: sums of n and of n ln(n_train + s) over the
    document's features that ``trained(slot, feature, n0..)`` holds for its fold.

    A feature's training counts of all folds are one row.  While those are few they
    go to the cells, which then stay where their document is."""
    each = range(n_classes)
    model = trained.groupBy("feature").agg(F.map_from_entries(F.collect_list(
        F.struct("slot", F.struct(*[f"n{i}" for i in each])))).alias("_m"), F.max("slot").alias("_last"))
    model = model.select("feature", F.transform(F.sequence(F.lit(0), "_last"), lambda s: F.try_element_at("_m", s)).alias("_m"))
    model = model.persist(StorageLevel.MEMORY_AND_DISK)
    cells = scalar(model.agg(F.sum(F.size("_m")).alias("s")), "s") or 0
    # The entries, and so the bytes, are counted, not the rows.
    x = with_slots.select("doc_id", "feature", "n", "_slots").join(F.broadcast(model) if cells <= MODEL_ENTRIES else model, "feature")
    x = x.select("doc_id", "n", "_m", F.explode("_slots").alias("_s")).select(
        "doc_id", "_s.repeat", "_s.fold", "n", F.get("_m", F.col("_s.slot")).alias("_t")).filter(F.col("_t").isNotNull())
    sums = [F.sum(F.col("n") * safe_ln(F.col(f"_t.n{i}") + F.lit(float(s)))).alias(f"sl{j}_{i}") for j, s in enumerate(smoothings) for i in each]
    return x.groupBy("doc_id", "repeat", "fold").agg(F.sum("n").alias("dlen"), *sums)


def nb_cross_validate(counts: DataFrame, docs: DataFrame, folds: DataFrame, smoothings=(1.0,),
                      classes=None) -> DataFrame:
    """All folds, repeats and smoothing values in one plan.

    Training counts of fold f are total - counts of fold f, so the data is
    aggregated once per (feature) and once per (repeat, fold, feature),
    class counts kept side by side in columns.  Folds are attached as one array a
    document and the model as one array a feature, so no cell is shuffled for a
    repeat.  Each test document is scored against the model of its own fold:
        ln prior + sum_w n ln(n_train + s) - |d| ln(T_train + s V).
    Returns ``(repeat, smoothing, fold, doc_id, actual, predicted)``.
    """
    classes = classes or class_values(docs)
    L = range(len(classes))
    is_c = [F.col("label") == F.lit(c) for c in classes]

    def by_class(col, prefix):
        return [F.sum(F.when(is_c[i], F.col(col)).otherwise(0)).alias(f"{prefix}{i}") for i in L]

    lab_counts = counts.select("doc_id", "label", "feature", "n")
    placed, slots = _placed(folds)
    with_slots = lab_counts.join(placed, "doc_id")                   # one row per document feature
    # per feature: few rows, which the scalars and the model read
    ct = lab_counts.groupBy("feature").agg(*by_class("n", "ct")).persist(StorageLevel.MEMORY_AND_DISK)
    ta = ct.agg(F.count(F.lit(1)).alias("v"), *[F.sum(f"ct{i}").alias(f"ta{i}") for i in L]).first()
    v = ta["v"]
    cf = with_slots.select("label", "feature", "n", F.explode("_slots").alias("_s")).groupBy("_s.slot", "feature").agg(*by_class("n", "cf"))
    trained = cf.join(ct, "feature").select("slot", "feature", *[(F.col(f"ct{i}") - F.col(f"cf{i}")).alias(f"n{i}") for i in L])
    # class token and document totals: tiny tables (repeats x folds rows)
    one = F.lit(1)
    dfold = docs.select("doc_id", "label").join(folds, "doc_id")
    na = docs.agg(*[F.sum(F.when(is_c[i], one).otherwise(0)).alias(f"na{i}") for i in L]).first()
    nf = dfold.groupBy("repeat", "fold").agg(*[F.sum(F.when(is_c[i], one).otherwise(0)).alias(f"nf{i}") for i in L])
    tf = cf.groupBy("slot").agg(*[F.sum(f"cf{i}").alias(f"tf{i}") for i in L]).join(F.broadcast(slots), "slot").drop("slot")
    stats = nf.join(tf, ["repeat", "fold"], "left")
    train_docs = [F.lit(int(na[f"na{i}"] or 0)) - F.col(f"nf{i}") for i in L]
    total_docs = sum(train_docs[1:], train_docs[0])
    stats = stats.select("repeat", "fold",
                         *[(train_docs[i] / total_docs).alias(f"prior{i}") for i in L],
                         *[(F.lit(int(ta[f"ta{i}"] or 0)) - F.coalesce(F.col(f"tf{i}"), F.lit(0))).alias(f"t{i}") for i in L])

    sums = _log_sums(with_slots, trained, smoothings, len(classes))
    test = (dfold.select("doc_id", F.col("label").alias("actual"), "repeat", "fold")
            .join(sums, ["doc_id", "repeat", "fold"], "left")
            .join(F.broadcast(stats), ["repeat", "fold"]))               # repeats x folds rows
    outs = []
    for j, s in enumerate(smoothings):
        scores = [safe_ln(F.col(f"prior{i}")) + F.coalesce(F.col(f"sl{j}_{i}"), F.lit(0.0))
                  - F.coalesce(F.col("dlen"), F.lit(0)) * safe_ln(F.col(f"t{i}") + F.lit(float(s) * v))
                  for i in L]
        outs.append(F.struct(F.lit(float(s)).alias("smoothing"),
                             _argmax(scores, [F.col(f"prior{i}") for i in L], classes).alias("predicted")))
    res = test.select("repeat", "fold", "doc_id", "actual", F.explode(F.array(*outs)).alias("o"))
    return res.select("repeat", "o.smoothing", "fold", "doc_id", "actual", "o.predicted")


# ------------------------------------------------- selection on training folds
def _by_class(classes: list, value, prefix: str) -> list:
    return [F.sum(F.when(F.col("label") == F.lit(c), value).otherwise(0)).alias(f"{prefix}{i}") for i, c in enumerate(classes)]


def train_fold_vocabulary(counts: DataFrame, docs: DataFrame, folds: DataFrame, classes: list, k=1000) -> DataFrame:
    """D7 per fold: ``(repeat, fold, feature)``, the per-class top k (ties kept) by
    the tf-idf of the documents outside the fold.

    Document frequencies and class sums of the other folds are total - fold, so
    the cells are aggregated twice, whatever the number of folds; idf, too,
    knows the training documents only.  All (repeat, fold, class) groups are
    ranked in one plan by counted values, without a task per group."""
    each = range(len(classes))
    stats = [F.count(F.lit(1)).alias("df"), *_by_class(classes, tf_log(F.col("n")), "tf"), *_by_class(classes, F.lit(1), "in")]
    total = counts.groupBy("feature").agg(*stats)
    inside = counts.join(folds, "doc_id").groupBy("repeat", "fold", "feature").agg(*stats)
    inside = inside.select("repeat", "fold", "feature", F.col("df").alias("df_"),
                           *[F.col(f"{p}{i}").alias(f"{p}{i}_") for p in ("tf", "in") for i in each])
    n = docs.count()
    # One entry a fold: repeats x folds entries, written into the plan.
    sizes = docs.select("doc_id").join(folds, "doc_id").groupBy("repeat", "fold").agg(F.count(F.lit(1)).alias("n")).collect()
    held = F.array(*[F.struct(F.lit(r["repeat"]).alias("repeat"), F.lit(r["fold"]).alias("fold"), F.lit(n - r["n"]).alias("n_train"))
                     for r in sizes])
    grid = total.withColumn("f", F.explode(held)).select("*", "f.*").drop("f").join(inside, ["repeat", "fold", "feature"], "left")

    def rest(name):
        return F.col(name) - F.coalesce(F.col(name + "_"), F.lit(0))

    idf = F.log10(F.col("n_train") / rest("df"))
    cells = F.array(*[F.struct(F.lit(c).alias("label"), rest(f"in{i}").alias("docs"), (rest(f"tf{i}") * idf).alias("frequency"))
                      for i, c in enumerate(classes)])
    freq = grid.filter(rest("df") > 0).select("repeat", "fold", "feature", F.explode(cells).alias("c")).select(
        "repeat", "fold", "feature", "c.label", "c.docs", "c.frequency").filter("docs > 0").drop("docs")
    return top_k(freq, ["repeat", "fold", "label"], k).select("repeat", "fold", "feature").distinct()


def nb_cross_validate_selected(counts: DataFrame, docs: DataFrame, folds: DataFrame, selected: DataFrame, smoothings=(1.0,),
                               classes=None) -> DataFrame:
    """K5 with a vocabulary of its own in every fold, ``selected(repeat, fold, feature)``.

    As ``nb_cross_validate``: training counts are total - fold; class totals and
    the vocabulary's size are summed over the fold's features."""
    classes = classes or class_values(docs)
    each = range(len(classes))
    placed, slots = _placed(folds)
    with_slots = counts.select("doc_id", "label", "feature", "n").join(placed, "doc_id")
    total = counts.groupBy("feature").agg(*_by_class(classes, F.col("n"), "ct"))
    inside = with_slots.select("label", "feature", "n", F.explode("_slots").alias("_s")).groupBy(
        "_s.repeat", "_s.fold", "feature").agg(*_by_class(classes, F.col("n"), "cf"))
    trained = selected.join(total, "feature").join(inside, ["repeat", "fold", "feature"], "left").select(
        "repeat", "fold", "feature", *[(F.col(f"ct{i}") - F.coalesce(F.col(f"cf{i}"), F.lit(0))).alias(f"n{i}") for i in each])
    trained = trained.persist(StorageLevel.MEMORY_AND_DISK)  # selected features only
    sizes = trained.groupBy("repeat", "fold").agg(F.count(F.lit(1)).alias("v"), *[F.sum(f"n{i}").alias(f"t{i}") for i in each])

    own = docs.select("doc_id", "label").join(folds, "doc_id")
    all_docs = docs.agg(*_by_class(classes, F.lit(1), "na")).first()
    train_docs = [F.lit(int(all_docs[f"na{i}"] or 0)) - F.col(f"nf{i}") for i in each]
    prior = own.groupBy("repeat", "fold").agg(*_by_class(classes, F.lit(1), "nf")).select(
        "repeat", "fold", *[(train_docs[i] / sum(train_docs[1:], train_docs[0])).alias(f"prior{i}") for i in each])
    stats = prior.join(sizes, ["repeat", "fold"], "left")  # repeats x folds rows

    scored = _log_sums(with_slots, trained.join(F.broadcast(slots), ["repeat", "fold"]), smoothings, len(classes))
    test = own.select("doc_id", F.col("label").alias("actual"), "repeat", "fold").join(
        scored, ["doc_id", "repeat", "fold"], "left").join(F.broadcast(stats), ["repeat", "fold"])
    outs = []
    for j, s in enumerate(smoothings):
        scores = [safe_ln(F.col(f"prior{i}")) + F.coalesce(F.col(f"sl{j}_{i}"), F.lit(0.0)) - F.coalesce(F.col("dlen"), F.lit(0))
                  * safe_ln(F.coalesce(F.col(f"t{i}"), F.lit(0)) + F.lit(float(s)) * F.coalesce(F.col("v"), F.lit(0))) for i in each]
        outs.append(F.struct(F.lit(float(s)).alias("smoothing"), _argmax(scores, [F.col(f"prior{i}") for i in each], classes).alias("predicted")))
    res = test.select("repeat", "fold", "doc_id", "actual", F.explode(F.array(*outs)).alias("o"))
    return res.select("repeat", "o.smoothing", "fold", "doc_id", "actual", "o.predicted")
