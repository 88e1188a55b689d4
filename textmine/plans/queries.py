"""Registered queries: one per operator of the inventory, each reading the
driver's tables at ``sf_dir`` and returning a DataFrame, plus the DuckDB
twin of each where SQL can state it.

Float results are rounded to 6 places in both engines; every computed
column is aliased identically on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmine.plans import sqlfrag as S
from textmine.sources import testdata as td
from textmine.operators import tokens as tk
from textmine.operators import features as ft
from textmine.operators.util import by_document

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# ----------------------------------------------------------- shared pieces
UNIGRAM_FLAGS = dict(remove_numbers=True, remove_punct=True, remove_symbols=True, remove_url=True)
UNIGRAM_SQL_FLAGS = dict(numbers=True, punct=True, symbols=True, url=True)


def unigram_tokens(df: DataFrame, keep=()) -> DataFrame:
    """L1 tokens: word tokens without numbers, punctuation, symbols, URLs."""
    return tk.explode_tokens(tk.tokenize_words(df, **UNIGRAM_FLAGS), keep=keep)


def reuse(df: DataFrame) -> DataFrame:
    """Persist a table that several jobs of one query read (eager scalars
    and the final plan); spills to disk, recomputed from lineage if lost."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def labelled_parts(spark, sf_dir) -> DataFrame:
    """The labelled texts, dealt out by document and kept so."""
    return reuse(by_document(td.labelled_corpus(spark, sf_dir).select("doc_id", "label", "text")))


def unigram_counts(spark, sf_dir, labelled=True, persist=False) -> DataFrame:
    # The labelled texts are read several times (bounds, selection, selected cells): dealt out once.
    base = labelled_parts(spark, sf_dir) if labelled else by_document(td.corpus(spark, sf_dir))
    keep = ("label",) if labelled else ()
    c = ft.dfm(unigram_tokens(base, keep=keep), by=("doc_id", *keep))
    return reuse(c) if persist else c


def n_docs(spark, sf_dir, labelled=True) -> int:
    """Number of documents of the corpus (idf's N)."""
    base = td.labelled_corpus(spark, sf_dir) if labelled else td.corpus(spark, sf_dir)
    return ft.document_count(base)


SQL_UNI_TOKENS_ALL = S.explode(S.DOCS, S.word_tokens(**UNIGRAM_SQL_FLAGS))
SQL_UNI_TOKENS_LAB = S.explode(S.LABELLED, S.word_tokens(**UNIGRAM_SQL_FLAGS), keep="doc_id, label")
SQL_UNI_COUNTS_ALL = f"SELECT doc_id, lower(term) AS feature, count(*) AS n FROM ({SQL_UNI_TOKENS_ALL}) GROUP BY ALL"
SQL_UNI_COUNTS_LAB = f"SELECT doc_id, label, lower(term) AS feature, count(*) AS n FROM ({SQL_UNI_TOKENS_LAB}) GROUP BY ALL"


def sql_tfidf(counts_sql: str, docs_sql: str, extra="") -> str:
    """tf-idf rows of a counts table (doc_id[, label], feature, n); N = documents of the corpus."""
    return (f"WITH c AS ({counts_sql}), nd AS (SELECT count(DISTINCT doc_id) AS nd FROM ({docs_sql})), "
            f"dfreq AS (SELECT feature, count(*) AS docfreq FROM c GROUP BY feature) "
            f"SELECT c.*{extra}, (1 + log10(c.n)) * log10(nd.nd / dfreq.docfreq) AS weight "
            f"FROM c JOIN dfreq ON c.feature = dfreq.feature CROSS JOIN nd")


def sql_dictionary_builder(counts_sql: str, docs_sql: str = S.LABELLED, k=1000) -> str:
    return (f"WITH w AS ({sql_tfidf(counts_sql, docs_sql)}), "
            f"fr AS (SELECT label, feature, sum(weight) AS frequency FROM w GROUP BY ALL), "
            f"rk AS (SELECT feature, rank() OVER (PARTITION BY label ORDER BY round(frequency, 6) DESC) AS r FROM fr) "
            f"SELECT DISTINCT feature FROM rk WHERE r <= {k}")


def dictionary_vocab(counts: DataFrame, n: int, k=1000) -> DataFrame:
    """The per-class top-k vocabulary: few rows, kept as several steps of a query read them."""
    return reuse(ft.dictionary_builder(ft.reachable_class_frequency(counts, n, k, CLASSES), k=k))


# ================================================================ B: tokens
@query("tokens_ws", S.explode(S.DOCS, S.ws_tokens(punct=True)))
def q_tokens_ws(spark, sf_dir):
    """B2 whitespace tokens (punctuation-only tokens removed), long form."""
    return tk.explode_tokens(tk.tokenize_ws(td.corpus(spark, sf_dir), remove_punct=True))


@query("tokens_word", SQL_UNI_TOKENS_ALL)
def q_tokens_word(spark, sf_dir):
    """B1 word tokens with the unigram switches, long form."""
    return unigram_tokens(td.corpus(spark, sf_dir))


# =========================================================== D: dfm & tfidf
@query("dfm_counts", SQL_UNI_COUNTS_ALL)
def q_dfm_counts(spark, sf_dir):
    """D1 lower-cased feature counts per document."""
    return unigram_counts(spark, sf_dir, labelled=False)


@query("tfidf", f"SELECT doc_id, feature, n, round(weight, 6) AS weight FROM ({sql_tfidf(SQL_UNI_COUNTS_ALL, S.DOCS)})")
def q_tfidf(spark, sf_dir):
    """D2 tf-idf (logcount x inverse document frequency)."""
    # The cells (fewer than the words) are kept: document frequencies and weights both read them.
    w = ft.tfidf(unigram_counts(spark, sf_dir, labelled=False, persist=True), n_docs=n_docs(spark, sf_dir, False))
    return w.select("doc_id", "feature", "n", F.round("weight", 6).alias("weight"))


@query("dictionary_builder", sql_dictionary_builder(SQL_UNI_COUNTS_LAB))
def q_dictionary_builder(spark, sf_dir):
    """D7 per-class top-1000 tf-idf vocabulary (ties kept)."""
    return dictionary_vocab(unigram_counts(spark, sf_dir), n_docs(spark, sf_dir))


# ============================================================ K: evaluation
from textmine.operators import bayes as nb  # noqa: E402
from textmine.operators import folds as fo  # noqa: E402
from textmine.operators import metrics as me  # noqa: E402
from textmine.plans import sql_eval as SE  # noqa: E402

CLASSES = ["n", "o", "p"]
SQL_DOCS_LAB = S.LABELLED
SQL_NB_COUNTS = (f"SELECT * FROM ({SQL_UNI_COUNTS_LAB}) WHERE feature IN "
                 f"(SELECT feature FROM ({sql_dictionary_builder(SQL_UNI_COUNTS_LAB)}))")


def nb_inputs(spark, sf_dir):
    """L1 Naive Bayes inputs: counts of the selected vocabulary and the
    labelled documents."""
    counts = unigram_counts(spark, sf_dir)
    vocab = dictionary_vocab(counts, n_docs(spark, sf_dir))
    docs = td.labelled_corpus(spark, sf_dir).select("doc_id", "label")
    # All cells are counted anew rather than kept: only the selected ones are read again.
    return reuse(ft.select_features(counts, vocab)), docs


def nb_cv(spark, sf_dir, repeats=1, smoothings=(1.0,), k=10, seed=1):
    counts, docs = nb_inputs(spark, sf_dir)
    folds = fo.assign_folds(docs, k=k, seed=seed, repeats=repeats)
    return nb.nb_cross_validate(counts, docs, folds, smoothings, classes=CLASSES)


def _r6(*cols):
    return [F.round(c, 6).alias(c) for c in cols]


@query("assign_folds", SE.folds_sql(SQL_DOCS_LAB))
def q_assign_folds(spark, sf_dir):
    """K1 ten near-equal folds of the labelled documents."""
    return fo.assign_folds(td.labels(spark, sf_dir), k=10, seed=1)


@query("fold_split", f"WITH f AS ({SE.folds_sql(SQL_DOCS_LAB)}) SELECT l.doc_id, l.label, f.fold, "
       f"CASE WHEN f.fold = 3 THEN 'test' ELSE 'train' END AS role FROM ({SQL_DOCS_LAB}) l JOIN f ON l.doc_id = f.doc_id")
def q_fold_split(spark, sf_dir):
    """P4 train/test roles of every labelled document for fold 3."""
    docs = td.labelled_corpus(spark, sf_dir).select("doc_id", "label")
    return fo.split_fold(docs, fo.assign_folds(docs), 3).select("doc_id", "label", "fold", "role")


SQL_NB_MODEL = f"""WITH c AS ({SQL_NB_COUNTS}), docs AS (SELECT doc_id, label FROM ({SQL_DOCS_LAB})),
vv AS (SELECT count(DISTINCT feature) AS v FROM c),
pr AS (SELECT label, count(*) / sum(count(*)) OVER () AS prior FROM docs GROUP BY label),
nwc AS (SELECT label, feature, sum(n) AS n_wc FROM c GROUP BY ALL),
tot AS (SELECT label, sum(n_wc) AS t_c FROM nwc GROUP BY label),
grid AS (SELECT f.feature, pr.label, pr.prior FROM (SELECT DISTINCT feature FROM c) f CROSS JOIN pr),
m AS (SELECT g.label, g.feature, CAST(coalesce(nwc.n_wc, 0) AS BIGINT) AS n_wc,
             (coalesce(nwc.n_wc, 0) + 1.0) / (coalesce(tot.t_c, 0) + 1.0 * vv.v) AS p_wgc, g.prior
      FROM grid g CROSS JOIN vv LEFT JOIN nwc ON nwc.label = g.label AND nwc.feature = g.feature
      LEFT JOIN tot ON tot.label = g.label)"""


def nb_model_df(spark, sf_dir, smoothing=1.0):
    counts, docs = nb_inputs(spark, sf_dir)
    return nb.nb_fit(counts, docs, smoothing, classes=CLASSES)


@query("nb_model", SQL_NB_MODEL + " SELECT label, feature, n_wc, round(p_wgc, 6) AS p_wgc, round(prior, 6) AS prior FROM m")
def q_nb_model(spark, sf_dir):
    """K2 multinomial NB fit on all labelled documents (s = 1)."""
    m = nb_model_df(spark, sf_dir)
    return m.select("label", "feature", "n_wc", *_r6("p_wgc", "prior"))


SQL_NB_POST = SQL_NB_MODEL + """, post AS (SELECT label, feature, p_wgc * prior / sum(p_wgc * prior) OVER (PARTITION BY feature) AS p_cgw FROM m)"""


@query("nb_posterior", SQL_NB_POST + " SELECT label, feature, round(p_cgw, 6) AS p_cgw FROM post")
def q_nb_posterior(spark, sf_dir):
    """K4 posterior P(class | word)."""
    return nb.nb_posterior(nb_model_df(spark, sf_dir)).select("label", "feature", *_r6("p_cgw"))


@query("nb_top_words", SQL_NB_POST + """ SELECT label, feature, round(p_cgw, 6) AS p_cgw, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY label ORDER BY round(p_cgw, 6) DESC, feature) AS INTEGER) AS rank FROM post)
  WHERE rank <= 10""")
def q_nb_top_words(spark, sf_dir):
    """K4 + D17: ten most likely words per class by P(class | word)."""
    post = nb.nb_posterior(nb_model_df(spark, sf_dir))
    return ft.top_n(post, "p_cgw", 10, per="label").select("label", "feature", *_r6("p_cgw"), "rank")


@query("nb_polarity_table", SQL_NB_POST + """ SELECT feature,
  round(max(CASE WHEN label = 'n' THEN p_cgw END), 6) AS n, round(max(CASE WHEN label = 'o' THEN p_cgw END), 6) AS o,
  round(max(CASE WHEN label = 'p' THEN p_cgw END), 6) AS p FROM post GROUP BY feature""")
def q_nb_polarity_table(spark, sf_dir):
    """K4/J3 word polarity table: one row per word, one column per class."""
    post = nb.nb_posterior(nb_model_df(spark, sf_dir))
    wide = post.groupBy("feature").pivot("label", CLASSES).agg(F.first("p_cgw"))
    return wide.select("feature", *_r6(*CLASSES))


@query("nb_predict", SQL_NB_MODEL + """, lp AS (SELECT label, feature, ln(p_wgc) AS lp, prior FROM m),
  sums AS (SELECT c.doc_id, lp.label, sum(c.n * lp.lp) AS s FROM c JOIN lp ON c.feature = lp.feature GROUP BY ALL),
  sc AS (SELECT d.doc_id, d.label AS actual, pr.label, pr.prior, ln(pr.prior) + coalesce(s.s, 0) AS score
         FROM docs d CROSS JOIN pr LEFT JOIN sums s ON s.doc_id = d.doc_id AND s.label = pr.label)
  SELECT doc_id, actual, label AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY doc_id
  ORDER BY round(score, 6) DESC, prior DESC, label) AS rn FROM sc) WHERE rn = 1""")
def q_nb_predict(spark, sf_dir):
    """K3 NB prediction of every labelled document with the full-data model."""
    counts, docs = nb_inputs(spark, sf_dir)
    model = nb.nb_fit(counts, docs, 1.0, classes=CLASSES)
    return nb.nb_predict(counts, docs, model, classes=CLASSES)


SQL_CV1 = "WITH " + SE.nb_cv_sql(SQL_NB_COUNTS, SQL_DOCS_LAB).lstrip()
KEYS = ["repeat", "smoothing", "fold"]


@query("nb_cv_predictions", SQL_CV1 + " SELECT * FROM pred")
def q_nb_cv_predictions(spark, sf_dir):
    """K5 ten-fold NB cross-validation predictions in one plan (s = 1)."""
    return nb_cv(spark, sf_dir)


@query("nb_cv_confusion", SQL_CV1 + "," + SE.confusion_sql(KEYS) + " SELECT * FROM conf")
def q_nb_cv_confusion(spark, sf_dir):
    """K11 confusion table per fold on the full class grid."""
    return me.confusion(nb_cv(spark, sf_dir), CLASSES, KEYS)


SQL_CM = SQL_CV1 + "," + SE.confusion_sql(KEYS) + "," + SE.class_metrics_sql(KEYS)


@query("nb_cv_metrics", SQL_CM + " SELECT repeat, smoothing, fold, label, support, tp, n_predicted, "
       "round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM cm")
def q_nb_cv_metrics(spark, sf_dir):
    """K12 per-class precision / recall / F1 per fold (NULL = NaN)."""
    cm = me.class_metrics(me.confusion(nb_cv(spark, sf_dir), CLASSES, KEYS), KEYS)
    return cm.select(*KEYS, "label", "support", "tp", "n_predicted", *_r6("precision", "recall", "f1"))


SQL_FM = SQL_CM + "," + SE.fold_metrics_sql(KEYS)


@query("nb_cv_fold_metrics", SQL_FM + " SELECT repeat, smoothing, fold, round(macro_f1, 6) AS macro_f1, "
       "round(micro_f1, 6) AS micro_f1, round(weighted_f1, 6) AS weighted_f1 FROM fm")
def q_nb_cv_fold_metrics(spark, sf_dir):
    """K13/K14 macro, micro and weighted F1 per fold."""
    fm = me.fold_metrics(me.class_metrics(me.confusion(nb_cv(spark, sf_dir), CLASSES, KEYS), KEYS), KEYS)
    return fm.select(*KEYS, *_r6("macro_f1", "micro_f1", "weighted_f1"))


def _summary_sql(cv_sql):
    keys = KEYS
    return (cv_sql + "," + SE.confusion_sql(keys) + "," + SE.class_metrics_sql(keys) + "," + SE.fold_metrics_sql(keys) +
            " SELECT repeat, smoothing, round(avg(macro_f1), 6) AS macro_f1, round(avg(micro_f1), 6) AS micro_f1, "
            "round(avg(weighted_f1), 6) AS weighted_f1, count(*) AS n_folds FROM fm GROUP BY ALL")


def _summary(pred):
    fm = me.fold_metrics(me.class_metrics(me.confusion(pred, CLASSES, KEYS), KEYS), KEYS)
    s = me.cv_summary(fm, ["repeat", "smoothing"])
    return s.select("repeat", "smoothing", *_r6("macro_f1", "micro_f1", "weighted_f1"), "n_folds")


@query("nb_cv_summary", _summary_sql(SQL_CV1))
def q_nb_cv_summary(spark, sf_dir):
    """K15 mean macro / micro / weighted F1 over the ten folds."""
    return _summary(nb_cv(spark, sf_dir))


SMOOTHINGS = (0.0, 1.0, 2.0, 3.0, 4.0, 5.0)


@query("nb_smoothing_sweep", _summary_sql("WITH " + SE.nb_cv_sql(SQL_NB_COUNTS, SQL_DOCS_LAB, smoothings=SMOOTHINGS).lstrip()))
def q_nb_smoothing_sweep(spark, sf_dir):
    """K16 smoothing 0..5 in one plan."""
    return _summary(nb_cv(spark, sf_dir, smoothings=SMOOTHINGS))


SQL_CV_TRAIN = "WITH " + SE.nb_cv_sql(SQL_UNI_COUNTS_LAB, SQL_DOCS_LAB, smoothings=(0.0, 1.0), train_top=1000).lstrip()


@query("nb_cv_train_selection", SQL_CV_TRAIN + " SELECT * FROM pred")
def q_nb_cv_train_selection(spark, sf_dir):
    """K5 with the vocabulary selected anew on the training documents of every fold (``select_on='train'``)."""
    counts = unigram_counts(spark, sf_dir, persist=True)
    docs = td.labelled_corpus(spark, sf_dir).select("doc_id", "label")
    folds = fo.assign_folds(docs, k=10, seed=1)
    selected = nb.train_fold_vocabulary(counts, docs, folds, CLASSES)
    return nb.nb_cross_validate_selected(counts, docs, folds, selected, (0.0, 1.0), CLASSES)


@query("train_fold_vocabulary", SQL_CV_TRAIN + " SELECT * FROM sel")
def q_train_fold_vocabulary(spark, sf_dir):
    """D7 per fold: the vocabulary of every fold's training documents."""
    counts = unigram_counts(spark, sf_dir, persist=True)
    docs = td.labelled_corpus(spark, sf_dir).select("doc_id", "label")
    return nb.train_fold_vocabulary(counts, docs, fo.assign_folds(docs, k=10, seed=1), CLASSES)


SQL_REP = "WITH " + SE.nb_cv_sql(SQL_NB_COUNTS, SQL_DOCS_LAB, repeats=10, smoothings=SMOOTHINGS).lstrip()


@query("nb_repeat_se", SQL_REP + "," + SE.confusion_sql(KEYS) + "," + SE.class_metrics_sql(KEYS) + "," +
       SE.fold_metrics_sql(KEYS) + """, sm2 AS (SELECT repeat, smoothing, avg(macro_f1) AS m FROM fm GROUP BY ALL)
       SELECT smoothing, round(avg(m), 6) AS mean, round(stddev_samp(m) / sqrt(count(*)), 6) AS se, count(*) AS n_repeats
       FROM sm2 GROUP BY smoothing""")
def q_nb_repeat_se(spark, sf_dir):
    """K17/AG7 ten repeats x six smoothing values: mean and SE of macro F1."""
    pred = nb_cv(spark, sf_dir, repeats=10, smoothings=SMOOTHINGS)
    fm = me.fold_metrics(me.class_metrics(me.confusion(pred, CLASSES, KEYS), KEYS), KEYS)
    s = me.cv_summary(fm, ["repeat", "smoothing"])
    r = me.repeat_summary(s, ["smoothing"])
    return r.select("smoothing", *_r6("mean", "se"), "n_repeats")
