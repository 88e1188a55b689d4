"""Registered SVM queries.

A fit has no SQL form.  What stands around it has: the vectors, the feature
tables of each set, votes and the two-stage rule (on a fixed linear rule that
SQL can state) and the supports of every fold.  The fits themselves are held
against independent solvers in the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from textmine.functions.lexicons import MARKERS_CIT
from textmine.operators import features as ft
from textmine.operators import folds as fo
from textmine.operators import lexicon as lx
from textmine.operators import metrics as me
from textmine.operators import proximity as px
from textmine.operators import svm as sv
from textmine.operators import svm_primal as sp
from textmine.operators import tokens as tk
from textmine.operators.util import broadcast_if_small
from textmine.plans import feature_set_queries as fs
from textmine.plans import sql_eval as SE
from textmine.plans import sqlfrag as S
from textmine.plans import text_queries as tq
from textmine.plans.queries import (
    CLASSES, ORACLE, SQL_UNI_COUNTS_LAB, _r6, dictionary_vocab, labelled_parts, n_docs, query, reuse,
    sql_dictionary_builder,
    sql_tfidf, unigram_counts,
)
from textmine.sources import testdata as td


def svm_inputs(spark, sf_dir):
    """L1 SVM input: tf-idf of the selected vocabulary as sparse vectors."""
    counts = unigram_counts(spark, sf_dir)
    n = n_docs(spark, sf_dir)
    vocab = dictionary_vocab(counts, n)
    # A feature's weight depends on its own cells only, so the others can go first.
    w = ft.tfidf(reuse(ft.select_features(counts, vocab)), n_docs=n, selected=True)
    docs = td.labelled_corpus(spark, sf_dir).select("doc_id", "label")
    return sv.to_vectors(w, docs, vocab), docs


SQL_SEL_W = (f"SELECT doc_id, feature, weight FROM ({sql_tfidf(SQL_UNI_COUNTS_LAB, S.LABELLED)}) "
             f"WHERE feature IN (SELECT feature FROM ({sql_dictionary_builder(SQL_UNI_COUNTS_LAB)}))")


SQL_VOCAB_INDEX = (f"SELECT feature, CAST(row_number() OVER (ORDER BY md5(feature), feature) - 1 AS INTEGER) AS idx "
                   f"FROM ({sql_dictionary_builder(SQL_UNI_COUNTS_LAB)})")


@query("to_vectors", f"""WITH w AS ({SQL_SEL_W}), d AS (SELECT doc_id, label FROM ({S.LABELLED}))
  SELECT d.doc_id, d.label, CAST(count(w.weight) FILTER (WHERE w.weight <> 0) AS INTEGER) AS nnz,
         round(coalesce(sum(abs(w.weight)), 0.0), 6) AS norm1
  FROM d LEFT JOIN w ON d.doc_id = w.doc_id GROUP BY d.doc_id, d.label""")
def q_to_vectors(spark, sf_dir):
    """D14 one sparse tf-idf vector per labelled document: non-zero count and L1 norm."""
    vec, _ = svm_inputs(spark, sf_dir)
    return vec.select("doc_id", "label", F.size(F.filter("val", lambda x: x != 0)).alias("nnz"),
                      F.round(F.aggregate("val", F.lit(0.0), lambda a, x: a + F.abs(x)), 6).alias("norm1"))


@query("vector_entries", f"""WITH w AS ({SQL_SEL_W}), v AS ({SQL_VOCAB_INDEX})
  SELECT w.doc_id, v.idx, round(w.weight, 6) AS value FROM w JOIN v ON w.feature = v.feature""")
def q_vector_entries(spark, sf_dir):
    """D14 the vectors entry by entry: the index is the feature's rank by md5."""
    vec, _ = svm_inputs(spark, sf_dir)
    return vec.select("doc_id", F.explode(F.arrays_zip("idx", "val")).alias("e")).select(
        "doc_id", "e.idx", F.round("e.val", 6).alias("value"))


# ------------------------------- votes (K8) and two-stage rule (K9) on a fixed rule
NEUTRAL = "o"
_PAIRS = [("n", "o"), ("n", "p"), ("o", "p")]


def rule_margins(spark, sf_dir):
    """Margins of every pair and of neutral against the rest, as weights times
    the difference of the classes' mean weights: a rule without a fit."""
    vec, docs = svm_inputs(spark, sf_dir)
    w = vec.select("doc_id", "label", F.explode(F.arrays_zip("idx", "val")).alias("e")).select(
        "doc_id", "label", F.col("e.idx").alias("idx"), F.col("e.val").alias("v"))
    sizes = docs.groupBy("label").agg(F.count("*").alias("n"))
    sums = w.groupBy("idx").pivot("label", CLASSES).agg(F.sum("v")).fillna(0.0)
    n = sizes.groupBy().pivot("label", CLASSES).agg(F.first("n")).select(*[F.col(c).alias(f"n_{c}") for c in CLASSES])
    means = sums.join(F.broadcast(n))  # one row of class sizes
    rest = sum((F.col(c) for c in CLASSES if c != NEUTRAL), F.lit(0.0))
    n_rest = sum((F.col(f"n_{c}") for c in CLASSES if c != NEUTRAL), F.lit(0))
    diffs = [(F.col(a) / F.col(f"n_{a}") - F.col(b) / F.col(f"n_{b}")).alias(f"{a}{b}") for a, b in _PAIRS]
    diffs.append((F.col(NEUTRAL) / F.col(f"n_{NEUTRAL}") - rest / n_rest).alias("stage1"))
    names = [f"{a}{b}" for a, b in _PAIRS] + ["stage1"]
    diffs = broadcast_if_small(reuse(means.select("idx", *diffs)))
    m = w.join(diffs, "idx").groupBy("doc_id").agg(
        *[F.round(F.sum(F.col("v") * F.col(c)), 9).alias(c) for c in names])
    m = docs.join(m, "doc_id", "left").fillna(0.0)
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(c).alias("margin")) for k, a, b, c in
                      [("pair", CLASSES.index(a), CLASSES.index(b), f"{a}{b}") for a, b in _PAIRS]
                      + [("stage1", -1, -1, "stage1"), ("stage2", 0, 2, "np")]])
    return m.select(F.lit(1).alias("repeat"), F.lit(1).alias("fold"), "doc_id", F.col("label").alias("actual"),
                    F.explode(kinds).alias("x")).select("repeat", "fold", "doc_id", "actual", "x.*")


_SQL_RULE = f"""WITH w AS ({SQL_SEL_W}), d AS (SELECT doc_id, label FROM ({S.LABELLED})),
  n AS (SELECT label, count(*) AS n FROM d GROUP BY label),
  s AS (SELECT w.feature, {", ".join(f"coalesce(sum(weight) FILTER (label = '{c}'), 0.0) / (SELECT n FROM n WHERE label = '{c}') AS m_{c}" for c in CLASSES)},
        coalesce(sum(weight) FILTER (label <> 'o'), 0.0) / (SELECT sum(n) FROM n WHERE label <> 'o') AS m_rest
        FROM w JOIN d ON w.doc_id = d.doc_id GROUP BY w.feature),
  m AS (SELECT w.doc_id, {", ".join(f"round(sum(weight * (m_{a} - m_{b})), 9) AS {a}{b}" for a, b in _PAIRS)},
        round(sum(weight * (m_o - m_rest)), 9) AS stage1 FROM w JOIN s ON w.feature = s.feature GROUP BY w.doc_id),
  x AS (SELECT d.doc_id, label, {", ".join(f"coalesce({c}, 0.0) AS {c}" for c in ("no", "np", "op", "stage1"))} FROM d LEFT JOIN m ON d.doc_id = m.doc_id),
  v AS (SELECT *, (no > 0)::INT + (np > 0)::INT AS vn, (no <= 0)::INT + (op > 0)::INT AS vo, (np <= 0)::INT + (op <= 0)::INT AS vp FROM x)"""


@query("svm_votes", _SQL_RULE + """
  SELECT doc_id, label AS actual, CASE WHEN vn >= vo AND vn >= vp THEN 'n' WHEN vo >= vp THEN 'o' ELSE 'p' END AS predicted FROM v""")
def q_svm_votes(spark, sf_dir):
    """K8 one-vs-one votes, ties to the first class, over the fixed rule's margins."""
    pairs = rule_margins(spark, sf_dir).filter("kind = 'pair'")
    return sv.combine_votes(pairs, CLASSES).select("doc_id", "actual", "predicted")


@query("svm_two_stage_rule", _SQL_RULE + """
  SELECT doc_id, label AS actual, CASE WHEN stage1 > 0 THEN 'o' WHEN np > 0 THEN 'n' ELSE 'p' END AS predicted FROM v""")
def q_svm_two_stage_rule(spark, sf_dir):
    """K9 neutral first, then the polarity vote, over the fixed rule's margins."""
    staged = rule_margins(spark, sf_dir).filter("kind <> 'pair'")
    return sv.combine_votes(staged, CLASSES, neutral=NEUTRAL).select("doc_id", "actual", "predicted")


# ------------------------------------------------------------------ K10 drivers
def _cv_summary(pred):
    keys = ["repeat", "fold"]
    fm = me.fold_metrics(me.class_metrics(me.confusion(pred, CLASSES, keys), keys), keys)
    return me.cv_summary(fm, ["repeat"]).select("repeat", *_r6("macro_f1", "micro_f1", "weighted_f1"), "n_folds")


def svm_cv(spark, sf_dir, **kw):
    vec, docs = svm_inputs(spark, sf_dir)
    folds = fo.assign_folds(docs, k=10, seed=1)
    return sp.cross_validate(vec, folds, CLASSES, **kw)


@query("svm_linear_cv")
def q_svm_linear_cv(spark, sf_dir):
    """K7/K10 ten-fold linear SVC (one-vs-one, cost 1): mean F1 scores."""
    return _cv_summary(svm_cv(spark, sf_dir, cost=1.0, kernel="linear", scheme="ovo"))


@query("svm_rbf_cv")
def q_svm_rbf_cv(spark, sf_dir):
    """K6/K10 ten-fold RBF SVM (gamma = 1 / number of features, cost 100): mean F1 scores."""
    return _cv_summary(svm_cv(spark, sf_dir, cost=100.0, kernel="rbf"))


@query("svm_two_stage_cv")
def q_svm_two_stage_cv(spark, sf_dir):
    """K9/K10 two-stage SVC (neutral 'o' vs rest, then polarity), cost 1."""
    return _cv_summary(svm_cv(spark, sf_dir, cost=1.0, neutral="o"))


@query("svm_fold_classes")
def q_svm_fold_classes(spark, sf_dir):
    """K10 the per-fold, per-class table of the linear CV: support, precision, recall, F1."""
    keys = ["repeat", "fold"]
    table = me.class_metrics(me.confusion(svm_cv(spark, sf_dir, cost=1.0), CLASSES, keys), keys)
    return table


@query("svm_fold_support", f"""SELECT f.repeat, f.fold, d.label AS actual, count(*) AS support
  FROM ({SE.folds_sql(S.LABELLED)}) f JOIN ({S.LABELLED}) d ON f.doc_id = d.doc_id GROUP BY ALL""")
def q_svm_fold_support(spark, sf_dir):
    """K10 test documents of each class that every fold's machines have judged."""
    pred = svm_cv(spark, sf_dir, cost=1.0)
    return pred.groupBy("repeat", "fold", "actual").agg(F.count("*").alias("support"))


def _path_summary(vec, docs, costs):
    """Mean F1 scores of every cost of a grid; all machines of the grid are fitted together."""
    pred = sp.cost_path(vec, fo.assign_folds(docs, k=10, seed=1), CLASSES, costs)
    keys = ["cost", "repeat", "fold"]
    fm = me.fold_metrics(me.class_metrics(me.confusion(pred, CLASSES, keys), keys), keys)
    return me.cv_summary(fm, ["cost", "repeat"]).select("repeat", *_r6("macro_f1", "micro_f1", "weighted_f1"), "n_folds", "cost")


@query("svm_cost_sweep")
def q_svm_cost_sweep(spark, sf_dir):
    """K16 RBF costs 10**1 .. 10**5 on unigrams: mean F1 scores of each."""
    vec, docs = svm_inputs(spark, sf_dir)
    return _path_summary(vec, docs, [10.0**k for k in range(1, 6)])


@query("svm_cost_grid_unigram")
def q_svm_cost_grid_unigram(spark, sf_dir):
    """K16 the unigram grid: RBF costs 10**1 .. 10**3 by quarters of a power."""
    vec, docs = svm_inputs(spark, sf_dir)
    return _path_summary(vec, docs, [10.0 ** (1 + k / 4) for k in range(9)])


# ------------------------------------------------------- L2–L4 feature sets
def _set_vectors(counts_sides, docs, n):
    """tf-idf of every side's own selected vocabulary, summed, as sparse vectors."""
    parts = []
    for counts in counts_sides:
        w = ft.tfidf(reuse(fs._selected(counts, n)), n_docs=n, selected=True)
        parts.append(w.select("doc_id", "feature", F.col("weight").alias("n")))
    w = parts[0] if len(parts) == 1 else ft.combine(*parts)
    return sv.to_vectors(w.withColumnRenamed("n", "weight"), docs)


def _set_cv(counts_sides, docs, n, cost, repeats):
    """A ten-fold RBF SVM on a feature set."""
    folds = fo.assign_folds(docs, k=10, seed=1, repeats=repeats)
    return _cv_summary(sp.cross_validate(_set_vectors(counts_sides, docs, n), folds, CLASSES, cost=cost, kernel="rbf"))


@query("svm_cv_3gram")
def q_svm_cv_3gram(spark, sf_dir):
    """L2 1–3-grams of word tokens, RBF cost 63."""
    docs = fs._docs(spark, sf_dir)
    narrow = tk.tokenize_words(labelled_parts(spark, sf_dir), **fs.NGRAM_FLAGS)
    return _set_cv([fs._gram_counts(narrow, docs)], docs, n_docs(spark, sf_dir), 63.0, 1)


@query("svm_cost_grid_3gram")
def q_svm_cost_grid_3gram(spark, sf_dir):
    """K16 the 1–3-gram grid: RBF costs 10**1.5 .. 10**2.5 by tenths of a power."""
    docs = fs._docs(spark, sf_dir)
    narrow = tk.tokenize_words(labelled_parts(spark, sf_dir), **fs.NGRAM_FLAGS)
    vec = _set_vectors([fs._gram_counts(narrow, docs)], docs, n_docs(spark, sf_dir))
    return _path_summary(vec, docs, [10.0 ** (1.5 + k / 10) for k in range(11)])


def _fs1_sides(spark, sf_dir, docs):
    return [fs._gram_counts(fs._ws_tokens(spark, sf_dir), docs), fs._dependency_counts(spark, sf_dir, docs)]


@query("svm_cv_fs1")
def q_svm_cv_fs1(spark, sf_dir):
    """L3 1–3-grams of whitespace tokens and dependency triples, RBF cost 80, ten repeats."""
    docs = fs._docs(spark, sf_dir)
    return _set_cv(_fs1_sides(spark, sf_dir, docs), docs, n_docs(spark, sf_dir), 80.0, 10)


@query("svm_cost_grid_fs1")
def q_svm_cost_grid_fs1(spark, sf_dir):
    """K16 the grid of the grams with dependencies: RBF costs 10**1 .. 10**5."""
    docs = fs._docs(spark, sf_dir)
    vec = _set_vectors(_fs1_sides(spark, sf_dir, docs), docs, n_docs(spark, sf_dir))
    return _path_summary(vec, docs, [10.0**k for k in range(1, 6)])


@query("svm_cv_fs2")
def q_svm_cv_fs2(spark, sf_dir):
    """L4 as L3 with corpus-mode negation before the n-grams, RBF cost 100, ten repeats."""
    docs = fs._docs(spark, sf_dir)
    sides = [fs._gram_counts(fs._negated(spark, sf_dir), docs), fs._dependency_counts(spark, sf_dir, docs)]
    return _set_cv(sides, docs, n_docs(spark, sf_dir), 100.0, 10)


# ------------------------------------------- L5 / L6 marker feature sets
SUBJECTIVITY = ["neutral", "subjective"]
POLARITY = ["n", "p"]


def closest_subjective(spark, sf_dir, clean):
    """E2/E3 closest subjective word, as counts."""
    return lx.closest_dfm(tq.closest_subj_df(spark, sf_dir, clean), ["closest"], word_tokens=True)


def closest_parts(spark, sf_dir, clean, annot):
    """E2/E3 closest subjective word and E1/E3 closest verb, adjective, adverb, as counts."""
    return [closest_subjective(spark, sf_dir, clean), lx.closest_dfm(tq.closest_pos_df(spark, sf_dir, annot), ["verb", "adj", "adv"])]


def citation_part(spark, sf_dir):
    labelled = td.marked_corpus(spark, sf_dir).join(td.labels(spark, sf_dir).select("doc_id").distinct(), "doc_id", "left_semi")
    return lx.citation_stats(labelled, MARKERS_CIT)


def labelled_clean(spark, sf_dir):
    """Clean texts of the labelled documents, the only ones in the marker tables: dealt out and cleaned once for all parts."""
    return reuse(tq.clean_corpus(spark, sf_dir, dealt=True, of=td.labels(spark, sf_dir)).select("doc_id", "text"))


def selected_dependencies(spark, sf_dir, docs, annot, k=1000):
    """Dependency counts of the labelled documents, kept to the side's own per-class top k (ties kept)."""
    counts = fs._dependency_counts(spark, sf_dir, docs, annot)
    return ft.select_features(counts, reuse(ft.top_features(counts, k=k, ties="min"))).select("doc_id", "feature", "n")


def marker_table(spark, sf_dir, clean=None):
    """L5 features: citation counts, lexicon *presence*, closest-word counts, selected dependencies."""
    docs = td.labelled_corpus(spark, sf_dir).select("doc_id", "label")
    clean = clean if clean is not None else labelled_clean(spark, sf_dir)
    annot = tq.annotations(spark, sf_dir, clean=clean)
    parts = ft.combine(citation_part(spark, sf_dir), tq.lexicon_presence(spark, sf_dir, clean), *closest_parts(spark, sf_dir, clean, annot),
                       selected_dependencies(spark, sf_dir, docs, annot))
    return parts.join(docs.select("doc_id"), "doc_id", "left_semi")


def marker_counts_table(spark, sf_dir):
    """L6 features: citation counts, lexicon *counts* (plain list, words of three characters or more), closest words."""
    docs = td.labelled_corpus(spark, sf_dir).select("doc_id")
    clean = labelled_clean(spark, sf_dir)
    toks = tk.explode_tokens(tq.long_word_tokens(spark, sf_dir, clean=clean))
    lex = lx.lexicon_features(toks, tq.LEXICON_PLAIN, boolean=False)
    annot = tq.annotations(spark, sf_dir, clean=clean)
    return ft.combine(citation_part(spark, sf_dir), lex, *closest_parts(spark, sf_dir, clean, annot)).join(docs, "doc_id", "left_semi")


_SQL_CLOSEST = [f"SELECT doc_id, feature, n FROM ({tq.SQL_SUBJ_DFM} SELECT * FROM sd)", f"SELECT doc_id, feature, n FROM ({ORACLE['closest_dfm']})"]
_SQL_CITED = f"SELECT doc_id, feature, n FROM ({tq.SQL_CITSTATS})"
_SQL_DEP = (f"WITH c AS (SELECT f.*, l.label FROM ({ORACLE['dependency_features']}) f JOIN (SELECT doc_id, label FROM ({S.LABELLED})) l ON f.doc_id = l.doc_id), "
            f"t AS (SELECT DISTINCT feature FROM (SELECT feature, rank() OVER (PARTITION BY label ORDER BY sum(n) DESC) AS r FROM c GROUP BY label, feature) WHERE r <= 1000) "
            f"SELECT doc_id, feature, n FROM c WHERE feature IN (SELECT feature FROM t)")
_SQL_LEX_COUNTS = tq.sql_lookup(tq.SQL_MIN3_COUNTS, tq.LEXICON_PLAIN)


def _sql_table(*parts):
    union = " UNION ALL ".join(f"SELECT doc_id, feature, n FROM ({p})" for p in parts)
    return (f"SELECT doc_id, feature, CAST(sum(n) AS BIGINT) AS n FROM ({union}) "
            f"WHERE doc_id IN (SELECT doc_id FROM ({S.LABELLED})) GROUP BY ALL")


@query("marker_table", _sql_table(_SQL_CITED, tq.SQL_LEXICON, *_SQL_CLOSEST, _SQL_DEP))
def q_marker_table(spark, sf_dir):
    """L5 combined feature table before any fit."""
    return marker_table(spark, sf_dir)


@query("marker_counts_table", _sql_table(_SQL_CITED, _SQL_LEX_COUNTS, *_SQL_CLOSEST))
def q_marker_counts_table(spark, sf_dir):
    """L6 combined feature table before any fit."""
    return marker_counts_table(spark, sf_dir)


def svm_summary(feats, docs, classes, task: str, k: int, ties: str, **kw):
    """Per-class top-k features of the task's classes (D8 / D9), then a
    ten-fold SVM: mean F1 scores."""
    labelled = feats.join(docs, "doc_id")
    vocab = reuse(ft.top_features(labelled, group_col="label", value_col="n", k=k, ties=ties))
    w = ft.select_features(labelled, vocab).select("doc_id", "feature", F.col("n").cast("double").alias("weight"))
    vec = sv.to_vectors(w, docs, vocab)
    folds = fo.assign_folds(docs, k=10, seed=1)
    pred = sp.cross_validate(vec, folds, classes, **kw)
    keys = ["repeat", "fold"]
    fm = me.fold_metrics(me.class_metrics(me.confusion(pred, classes, keys), keys), keys)
    return (me.cv_summary(fm, ["repeat"])
            .select(F.lit(task).alias("task"), "repeat", *_r6("macro_f1", "micro_f1", "weighted_f1"), "n_folds"))


@query("svm_markers_cv")
def q_svm_markers_cv(spark, sf_dir):
    """Linear SVMs, cost 1, for subjectivity (neutral vs the rest) and for
    polarity on the non-neutral documents, each on its own per-class top-1000
    features (ties kept); and lexicon features alone, RBF cost 1000, for subjectivity."""
    clean = labelled_clean(spark, sf_dir)
    feats = reuse(marker_table(spark, sf_dir, clean))
    docs = td.labelled_corpus(spark, sf_dir).select("doc_id", "label")
    subj = docs.select("doc_id", F.when(F.col("label") == NEUTRAL, F.lit("neutral")).otherwise(F.lit("subjective")).alias("label"))
    polar = docs.filter(F.col("label") != NEUTRAL)
    lexicon = ft.combine(tq.lexicon_presence(spark, sf_dir, clean), closest_subjective(spark, sf_dir, clean))
    return (svm_summary(feats, subj, SUBJECTIVITY, "subjectivity", 1000, "min")
            .unionByName(svm_summary(feats, polar, POLARITY, "polarity", 1000, "min"))
            .unionByName(svm_summary(lexicon, subj, SUBJECTIVITY, "lexicon", 1000, "min", cost=1000.0, kernel="rbf")))


@query("svm_markers_counts_cv")
def q_svm_markers_counts_cv(spark, sf_dir):
    """Counts, per-class first 10000 features (random ties): three-class RBF, cost 1000, and the two-stage linear SVM."""
    feats = reuse(marker_counts_table(spark, sf_dir))
    docs = td.labelled_corpus(spark, sf_dir).select("doc_id", "label")
    return (svm_summary(feats, docs, CLASSES, "three_classes", 10000, "random", cost=1000.0, kernel="rbf")
            .unionByName(svm_summary(feats, docs, CLASSES, "two_stage", 10000, "random", neutral=NEUTRAL)))
