"""Registered queries of operator variants: the second marker vocabulary, lower ends
of rankings, section keys that occur in the data, policies, grids and readers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from textmine.functions.lexicons import MARKERS_TREF
from textmine.functions.text import sql_str
from textmine.operators import bayes as nb
from textmine.operators import features as ft
from textmine.operators import folds as fo
from textmine.operators import lexicon as lx
from textmine.operators import markers as mk
from textmine.operators import metrics as me
from textmine.operators import tokens as tk
from textmine.plans import feature_set_queries as fs
from textmine.plans import sql_eval as SE
from textmine.plans import sqlfrag as S
from textmine.plans import text_queries as tq
from textmine.plans.queries import (
    CLASSES, KEYS, SMOOTHINGS, SQL_CM, SQL_UNI_COUNTS_LAB, _r6, _summary, _summary_sql, n_docs, nb_cv, query, reuse,
    sql_tfidf, unigram_counts)
from textmine.session import checkpoint_dir
from textmine.sources import corpus as src
from textmine.sources import testdata as td

# --------------------------------------------------- markers in tags
# Tagged markers are injected like the bare ones: a citation with its text between the tags.
TREF_SQL = ("replace(replace(replace(text, ' the ', ' <TREF>Smith 2001</TREF> '), ' and ', ' <REF>Jones, 1999</REF> '), "
            "' by ', ' <REF>x</REF> ')")
SQL_TREF = f"SELECT doc_id, {TREF_SQL} AS text FROM documents"


def tref_corpus(spark, sf_dir):
    return td.corpus(spark, sf_dir).select("doc_id", F.expr(TREF_SQL).alias("text"))


_TARGET, _OTHER, _MARKUP = MARKERS_TREF
_C1 = S.c1("text", *MARKERS_TREF)
_C2 = S.c2(_C1, _TARGET, _OTHER)
_C4 = S.c4(S.c3(_C2, _TARGET, _OTHER), tq.PREPS, _TARGET, _OTHER)


@query("mark_citations_tref", f"SELECT doc_id, {_C1} AS text FROM ({SQL_TREF})")
def q_mark_citations_tref(spark, sf_dir):
    """C1 tagged markup with the second vocabulary -> marker words."""
    return tref_corpus(spark, sf_dir).select("doc_id", mk.mark_citations_col(F.col("text"), *MARKERS_TREF).alias("text"))


@query("group_citations_tref", f"SELECT doc_id, {_C2} AS text FROM ({SQL_TREF})")
def q_group_citations_tref(spark, sf_dir):
    """C2 runs of the second vocabulary's markers -> group markers."""
    marked = mk.mark_citations_col(F.col("text"), *MARKERS_TREF)
    return tref_corpus(spark, sf_dir).select("doc_id", mk.group_citations_col(marked, _TARGET, _OTHER).alias("text"))


@query("clean_citations_tref", f"SELECT doc_id, {S.c5(_C4, _TARGET, _OTHER)} AS text FROM ({SQL_TREF})")
def q_clean_citations_tref(spark, sf_dir):
    """C1–C5 the whole normalisation with the second vocabulary."""
    c = mk.group_citations_col(mk.mark_citations_col(F.col("text"), *MARKERS_TREF), _TARGET, _OTHER)
    c = mk.mark_syntactic_prep_col(mk.mark_syntactic_clause_col(c, _TARGET, _OTHER), tq.PREPS, _TARGET, _OTHER)
    return tref_corpus(spark, sf_dir).select("doc_id", mk.drop_nonsyntactic_col(c, _TARGET, _OTHER).alias("text"))


# ------------------------------------------------------- keyness, lower end
def _sql_tail(keyness_sql: str) -> str:
    return f"SELECT feature, chi2 FROM ({keyness_sql}) WHERE chi2 IS NOT NULL ORDER BY chi2, feature LIMIT 10"


def _tail(grouped, target):
    k = ft.keyness(grouped, target, measure="chi2").filter("chi2 is not null")
    return ft.top_n(k, "chi2", 10, desc=False).select("feature", *_r6("chi2"))


@query("keyness_tail", _sql_tail(tq.sql_keyness("n", "chi2")))
def q_keyness_tail(spark, sf_dir):
    """D16 + D17 the ten words that speak most against class n."""
    return _tail(ft.dfm_group(unigram_counts(spark, sf_dir)), "n")


@query("keyness_tail_dependencies", _sql_tail(tq.sql_keyness("p", "chi2", fs.SQL_DEP_COUNTS)))
def q_keyness_tail_dependencies(spark, sf_dir):
    """D16 + D17 the ten dependency triples that speak most against class p."""
    return _tail(ft.dfm_group(fs._dependency_counts(spark, sf_dir, fs._docs(spark, sf_dir))), "p")


# ------------------------------------------------------------- section keys (E5)
# Words and word pairs of the data in place of headings, which do not occur in it.
SAMPLE_SECTIONS = {"One": ["that", "this"], "Two": ["with the", "for the", "der"], "Three": ["from", "was"], "Four": ["are this", "not *"]}


@query("section_features_sample", tq.sql_lookup(f"{tq.SQL_MIN3_COUNTS} UNION ALL {tq.SQL_MIN3_PAIRS}", SAMPLE_SECTIONS))
def q_section_features_sample(spark, sf_dir):
    """E5 section keys on single tokens and adjacent pairs, with keys that occur."""
    return lx.section_features(tk.explode_tokens(tq.long_word_tokens(spark, sf_dir, dealt=True)), SAMPLE_SECTIONS, phrases=True)


# --------------------------------------------------- policies and grids
_FREQUENCY = f"SELECT label, feature, sum(weight) AS frequency FROM ({sql_tfidf(SQL_UNI_COUNTS_LAB, S.LABELLED)}) GROUP BY ALL"


@query("dictionary_builder_drop", f"""WITH fr AS ({_FREQUENCY}),
  rk AS (SELECT *, rank() OVER (PARTITION BY label ORDER BY round(frequency, 6) DESC) AS r, count(*) OVER (PARTITION BY label) AS n FROM fr)
  SELECT DISTINCT feature FROM rk WHERE r <= 2500 AND n >= 2500""")
def q_dictionary_builder_drop(spark, sf_dir):
    """D7 top 2500 a class, classes with fewer features left out."""
    freq = ft.tfidf_class_frequency(unigram_counts(spark, sf_dir), n_docs=n_docs(spark, sf_dir))
    return ft.dictionary_builder(freq, k=2500, short_class="drop")


@query("nb_cv_class_zero", SQL_CM + """ SELECT repeat, smoothing, fold, round(avg(coalesce(f1, 0.0)), 6) AS macro_f1,
  round(sum(CASE WHEN support > 0 THEN coalesce(f1, 0.0) * support END) / sum(support), 6) AS weighted_f1 FROM cm GROUP BY ALL""")
def q_nb_cv_class_zero(spark, sf_dir):
    """K13 a class whose F1 is undefined counts as 0 in the fold's mean."""
    cm = me.class_metrics(me.confusion(nb_cv(spark, sf_dir), CLASSES, KEYS), KEYS)
    return me.fold_metrics(cm, KEYS, nan_policy="class_zero").select(*KEYS, *_r6("macro_f1", "weighted_f1"))


@query("nb_smoothing_sweep_fs1", _summary_sql("WITH " + SE.nb_cv_sql(
    fs._sql_combined(fs._sql_gram_counts(fs.SQL_WS_TOKS_LAB)), S.LABELLED, smoothings=SMOOTHINGS).lstrip()))
def q_nb_smoothing_sweep_fs1(spark, sf_dir):
    """K16 smoothing 0..5 on the grams with dependencies."""
    labels, n = fs._docs(spark, sf_dir), n_docs(spark, sf_dir)
    grams = fs._selected(fs._gram_counts(fs._ws_tokens(spark, sf_dir), labels), n)
    deps = fs._selected(fs._dependency_counts(spark, sf_dir, labels), n)
    counts = reuse(ft.combine(grams, deps, by=("doc_id", "label")))
    return _summary(nb.nb_cross_validate(counts, labels, fo.assign_folds(labels, k=10, seed=1), SMOOTHINGS, classes=CLASSES))


@query("count_histogram_30", f"""WITH c AS (SELECT len(list_filter(string_split(regexp_replace(text, '(?i)<(CIT|OTH)>', 'REF', 'g'), ' '),
    lambda w: regexp_matches(w, {sql_str('(?i)REF')}))) AS count FROM ({S.MARKED})),
  r AS (SELECT min(count) AS low, max(count) AS high FROM c)
  SELECT CAST(least(29, floor((count - low) * 30.0 / greatest(high - low, 1))) AS INTEGER) AS bin, count(*) AS n_docs FROM c, r GROUP BY ALL""")
def q_count_histogram_30(spark, sf_dir):
    """AG6 documents by 30 equal bins of their reference count."""
    counts = td.marked_corpus(spark, sf_dir).select(F.coalesce(mk.count_references_col(F.col("text")), F.lit(0)).alias("count"))
    low, high = counts.agg(F.min("count"), F.max("count")).first()
    width = max((high or 0) - (low or 0), 1)
    bin_ = F.least(F.lit(29), F.floor((F.col("count") - F.lit(low or 0)) * 30.0 / width)).cast("int")
    return counts.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n_docs"))


# ------------------------------------------------------------------ readers (A1–A3)
def _as_csv(df):
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/csv-{uuid.uuid4().hex}"
    df.write.options(header="true", quote='"', escape='"', quoteAll="true").csv(path)
    return path


@query("read_corpus_csv", "SELECT doc_id, text, lang FROM documents")
def q_read_corpus_csv(spark, sf_dir):
    """A1 the corpus written as CSV, line ends inside quotes, and read back."""
    docs = td.corpus(spark, sf_dir).select(F.col("doc_id").alias("ID"), F.col("text").alias("Text"), "lang")
    return src.read_corpus(spark, _as_csv(docs), "ID long, Text string, lang string", ignoreLeadingWhiteSpace="false",
                           ignoreTrailingWhiteSpace="false", lineSep="\n", emptyValue="")


@query("read_corpus_dependencies", "SELECT doc_id, source || ' ' || lang AS text FROM documents")
def q_read_corpus_dependencies(spark, sf_dir):
    """A2 another column of the file as the text."""
    docs = td.corpus(spark, sf_dir).select(F.col("doc_id").alias("ID"), F.concat_ws(" ", "source", "lang").alias("Dependencies"))
    out = src.read_corpus(spark, _as_csv(docs), "ID long, Dependencies string", text_col="Dependencies", lineSep="\n")
    return out
