"""Registered queries for token, marker, feature-table, proximity and
lexicon operators (B, C, D, E, P, J, AG)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmine.functions.lexicons import (
    MARKERS_CIT, NEGATION_PATTERNS, NEGATION_WINDOW, SECTIONS, SEM_NEGATION, SEM_NEGATION_WITH_NT,
    lexicon_dictionary,
)
from textmine.functions.text import glob_to_regex, sql_str
from textmine.operators import features as ft
from textmine.operators import lexicon as lx
from textmine.operators import markers as mk
from textmine.operators import proximity as px
from textmine.operators import tokens as tk
from textmine.operators.util import by_document
from textmine.plans import sqlfrag as S
from textmine.plans.queries import (
    SQL_UNI_COUNTS_LAB, UNIGRAM_FLAGS, UNIGRAM_SQL_FLAGS, _r6, dictionary_vocab, n_docs, query, reuse,
    sql_dictionary_builder, sql_tfidf, unigram_counts, unigram_tokens,
)
from textmine.sources import corpus as src
from textmine.sources import testdata as td

PREPS = td.TEST_PREPOSITIONS
TARGET_RX_TAG = "(?i)(CIT|GCIT)(SYN)*_"
TARGET_RX_WORD = "(?i)(CIT|GCIT)(SYN)*"
MIN3_FLAGS = dict(remove_numbers=True, remove_punct=True, remove_url=True)
MIN3_SQL_FLAGS = dict(numbers=True, punct=True, url=True)


# ------------------------------------------------------------ shared data
def base_tokens(spark, sf_dir) -> DataFrame:
    """FS1/FS2 base tokens: whitespace split, punctuation-only tokens removed."""
    return tk.tokenize_ws(td.corpus(spark, sf_dir), remove_punct=True)


SQL_BASE_TOKS = f"SELECT doc_id, {S.ws_tokens(punct=True)} AS tokens FROM ({S.DOCS})"


def clean_corpus(spark, sf_dir, labelled=False, dealt=False, of=None) -> DataFrame:
    """Marked corpus after C1..C5 (columns doc_id, text=clean, grouped).  ``dealt``: in parts by
    document, for what is counted per document; ``of``: only documents with an id there."""
    m = td.marked_corpus(spark, sf_dir, labelled)
    if of is not None:
        m = m.join(of.select("doc_id").distinct(), "doc_id", "left_semi")
    if dealt:
        m = by_document(m)
    out = mk.normalise_markers(m, PREPS, vocab=MARKERS_CIT)
    keep = ["label"] if labelled else []
    return out.select("doc_id", F.col("clean").alias("text"), "grouped", *keep)


SQL_CLEAN = f"SELECT doc_id, {S.clean_text('text', PREPS)} AS text FROM ({S.MARKED})"


def long_word_tokens(spark, sf_dir, dealt=False, of=None, clean=None) -> DataFrame:
    """Word tokens of the clean text without numbers, punctuation, URLs,
    at least three characters (narrow form)."""
    c = clean if clean is not None else clean_corpus(spark, sf_dir, dealt=dealt, of=of)
    return c.select("doc_id", tk.min_chars(tk.word_tokens(F.col("text"), **MIN3_FLAGS), 3).alias("tokens"))


SQL_MIN3_TOKS = (f"SELECT doc_id, list_filter({S.word_tokens('text', **MIN3_SQL_FLAGS)}, lambda x: length(x) >= 3) AS tokens "
                f"FROM ({SQL_CLEAN})")
SQL_MIN3_LONG = S.explode(SQL_MIN3_TOKS, "tokens")


def annotations(spark, sf_dir, of=None, clean=None) -> DataFrame:
    """Stand-in annotation table of the detokenised clean text (A6b), of all documents, those in ``of`` or those of ``clean``."""
    words = long_word_tokens(spark, sf_dir, dealt=True, of=of, clean=clean)
    if of is not None or clean is not None:
        # Tables made of some documents are read several times (bounds, selection, selected cells): the texts are
        # dealt out, cleaned and cut into words once.  A word holds no space and no word is empty, so the text gives the words back.
        texts = reuse(words.select("doc_id", tk.detokenize(F.col("tokens")).alias("text")))
        words = tk.tokenize_ws(texts.filter("text is not null")).select("doc_id", "tokens")
    return src.lexicon_annotate(tk.explode_tokens(words), td.pos_lexicon(spark))


SQL_LEX = S.values(td.TEST_POS_LEXICON, ["word", "lemma", "upos"])
SQL_ANNOT = (f"SELECT t.doc_id, 1 AS sid, t.pos AS tid, t.term AS word, coalesce(l.lemma, t.term) AS lemma, "
             f"coalesce(l.upos, 'X') AS upos, CASE WHEN t.pos = 1 THEN 'root' ELSE 'dep' END AS relation, "
             f"t.pos - 1 AS tid_target FROM ({SQL_MIN3_LONG}) t LEFT JOIN {SQL_LEX} l ON lower(t.term) = l.word")


def sql_counts(long_sql: str, keep="doc_id") -> str:
    return f"SELECT {keep}, lower(term) AS feature, count(*) AS n FROM ({long_sql}) GROUP BY ALL"


# ================================================================ tokens (B)
@query("ngrams_1_3", " UNION ALL ".join(
    f"SELECT doc_id, CAST({n} AS INTEGER) AS n, pos, term FROM ({S.explode(SQL_BASE_TOKS, S.ngram_list('tokens', n))})"
    for n in (1, 2, 3)))
def q_ngrams_1_3(spark, sf_dir):
    """B3 1-, 2- and 3-grams joined by '_' of the base tokens."""
    return tk.ngrams_long(base_tokens(spark, sf_dir), ns=(1, 2, 3)).select("doc_id", "n", "pos", "term")


@query("min_chars", SQL_MIN3_LONG)
def q_min_chars(spark, sf_dir):
    """B1 + B7 tokens of at least three characters (clean text)."""
    return tk.explode_tokens(long_word_tokens(spark, sf_dir))


@query("uppercase_tokens", f"SELECT * FROM ({SQL_MIN3_LONG}) WHERE regexp_matches(term, '[A-Z]')")
def q_uppercase_tokens(spark, sf_dir):
    """B6 keep tokens containing an upper-case letter (case-sensitive regex)."""
    return tk.filter_tokens(tk.explode_tokens(long_word_tokens(spark, sf_dir)), "[A-Z]", keep=True, case_insensitive=False)


@query("remove_tokens_regex", f"SELECT * FROM ({S.explode(SQL_BASE_TOKS, 'tokens')}) "
       f"WHERE NOT regexp_matches(term, {sql_str('(?i)' + '.*[0-9].*|.*th.*')})")
def q_remove_tokens_regex(spark, sf_dir):
    """B6 remove tokens matching a regex (case-insensitive)."""
    return tk.filter_tokens(tk.explode_tokens(base_tokens(spark, sf_dir)), ".*[0-9].*|.*th.*", keep=False)


@query("detokenize", f"SELECT doc_id, array_to_string(tokens, ' ') AS text FROM ({SQL_MIN3_TOKS})")
def q_detokenize(spark, sf_dir):
    """B8 tokens joined back into one text per document."""
    return long_word_tokens(spark, sf_dir).select("doc_id", tk.detokenize(F.col("tokens")).alias("text"))


@query("types", f"SELECT DISTINCT term FROM ({S.explode(SQL_BASE_TOKS, 'tokens')})")
def q_types(spark, sf_dir):
    """B10 distinct token types."""
    return tk.types(tk.explode_tokens(base_tokens(spark, sf_dir)))


@query("replace_tokens", f"SELECT t.doc_id, t.pos, coalesce(l.upos, t.term) AS term FROM "
       f"({S.explode(SQL_BASE_TOKS, 'tokens')}) t LEFT JOIN {SQL_LEX} l ON t.term = l.word")
def q_replace_tokens(spark, sf_dir):
    """B11 replace tokens by a find -> replacement table (word -> POS tag)."""
    mapping = td.pos_lexicon(spark).select(F.col("word").alias("find"), F.col("upos").alias("replacement"))
    return tk.replace_tokens(tk.explode_tokens(base_tokens(spark, sf_dir)), mapping).select("doc_id", "pos", "term")


GLOBS = ["the*", "*tion", "a?d", "of", "Is"]


@query("keep_tokens_glob", f"SELECT * FROM ({S.explode(SQL_BASE_TOKS, 'tokens')}) WHERE "
       + " OR ".join(f"regexp_matches(lower(term), {sql_str(glob_to_regex(g.lower()))})" for g in GLOBS))
def q_keep_tokens_glob(spark, sf_dir):
    """B5 keep tokens matching glob patterns (case-insensitive)."""
    return tk.keep_tokens_glob(tk.explode_tokens(base_tokens(spark, sf_dir)), GLOBS)


@query("keep_tokens", f"SELECT t.* FROM ({S.explode(S.LABELLED, S.word_tokens(**UNIGRAM_SQL_FLAGS), keep='doc_id, label')}) t "
       f"WHERE lower(t.term) IN (SELECT feature FROM ({sql_dictionary_builder(SQL_UNI_COUNTS_LAB)}))")
def q_keep_tokens(spark, sf_dir):
    """B4 keep tokens in the selected vocabulary (case-insensitive)."""
    vocab = dictionary_vocab(unigram_counts(spark, sf_dir), n_docs(spark, sf_dir))
    toks = unigram_tokens(td.labelled_corpus(spark, sf_dir), keep=("label",))
    return tk.keep_tokens(toks, vocab).select("doc_id", "label", "term", "pos")


def _neg_sql(mode: str, w=NEGATION_WINDOW, toks_sql=SQL_BASE_TOKS) -> str:
    """Negation twin over a narrow token table ``toks_sql(doc_id, tokens)``."""
    pats = tk._parse_patterns(NEGATION_PATTERNS)
    t = f"t AS MATERIALIZED ({S.explode(toks_sql, 'tokens')})"
    sels = []
    for words in pats:
        m = len(words)
        joins = " ".join(f"JOIN t t{j} ON t{j}.doc_id = t0.doc_id AND t{j}.pos = t0.pos + {j}" for j in range(1, m + 1))
        conds = []
        for j, g in enumerate(words):
            conds.append(f"regexp_matches(lower(t{j}.term), {sql_str(glob_to_regex(g))})" if "*" in g or "?" in g
                         else f"lower(t{j}.term) = {sql_str(g)}")
        sels.append(f"SELECT t0.doc_id, t0.pos AS p, {m} AS m FROM t t0 {joins} WHERE {' AND '.join(conds)}")
    mt = f"mt AS (SELECT doc_id, p, max(m) AS m FROM ({' UNION ALL '.join(sels)}) GROUP BY ALL)"
    # The furthest end of a match that starts at or before a token.
    ends = ("fe AS (SELECT t.doc_id, t.pos, t.term, max(mt.p + mt.m) OVER (PARTITION BY t.doc_id ORDER BY t.pos) AS e "
            "FROM t LEFT JOIN mt ON mt.doc_id = t.doc_id AND mt.p = t.pos)")
    fl = (f"fl AS MATERIALIZED (SELECT doc_id, pos, term, coalesce(e + {w} >= pos, false) AS in_span, "
          f"coalesce(e >= pos, false) AS is_match FROM fe)")
    if mode == "window":
        tail = "SELECT doc_id, pos, CASE WHEN in_span AND NOT is_match THEN term || '_neg' ELSE term END AS term FROM fl"
    else:
        tail = ("SELECT fl.doc_id, fl.pos, CASE WHEN fl.in_span AND tags.term IS NOT NULL THEN fl.term || '_neg' ELSE fl.term END AS term "
                "FROM fl LEFT JOIN (SELECT DISTINCT term FROM fl WHERE in_span AND NOT is_match) tags ON tags.term = fl.term")
    return f"WITH {t}, {mt}, {ends}, {fl} {tail}"


@query("negation_window", _neg_sql("window"))
def q_negation_window(spark, sf_dir):
    """B9 window negation, window mode (15 tokens after each match)."""
    return tk.tag_negation(base_tokens(spark, sf_dir), mode="window")


@query("negation_corpus", _neg_sql("corpus"))
def q_negation_corpus(spark, sf_dir):
    """B9 window negation, corpus mode (tag set collected corpus-wide)."""
    return tk.tag_negation(base_tokens(spark, sf_dir), mode="corpus")


# =============================================================== markers (C)
@query("mark_citations", f"SELECT doc_id, {S.c1('text')} AS text FROM ({S.MARKED})")
def q_mark_citations(spark, sf_dir):
    """C1 markup -> marker words."""
    m = td.marked_corpus(spark, sf_dir)
    return m.select("doc_id", mk.mark_citations_col(F.col("text")).alias("text"))


@query("group_citations", f"SELECT doc_id, {S.c2(S.c1('text'))} AS text FROM ({S.MARKED})")
def q_group_citations(spark, sf_dir):
    """C2 runs of markers -> group markers."""
    m = td.marked_corpus(spark, sf_dir)
    return m.select("doc_id", mk.group_citations_col(mk.mark_citations_col(F.col("text"))).alias("text"))


@query("syntactic_markers", f"SELECT doc_id, {S.c4(S.c3(S.c2(S.c1('text'))), PREPS)} AS text FROM ({S.MARKED})")
def q_syntactic_markers(spark, sf_dir):
    """C3 + C4 syntactic marker tagging."""
    m = td.marked_corpus(spark, sf_dir)
    c = mk.mark_syntactic_prep_col(mk.mark_syntactic_clause_col(
        mk.group_citations_col(mk.mark_citations_col(F.col("text")))), PREPS)
    return m.select("doc_id", c.alias("text"))


@query("drop_markers", SQL_CLEAN)
def q_drop_markers(spark, sf_dir):
    """C5 remaining plain markers removed (neighbours glued)."""
    return clean_corpus(spark, sf_dir).select("doc_id", "text")


@query("reference_count", f"SELECT doc_id, CAST(len(list_filter(string_split(regexp_replace(text, '(?i)<(CIT|OTH)>', 'REF', 'g'), ' '), "
       f"lambda w: regexp_matches(w, '(?i)REF'))) AS INTEGER) AS count FROM ({S.MARKED})")
def q_reference_count(spark, sf_dir):
    """C6 number of words holding a reference marker."""
    m = td.marked_corpus(spark, sf_dir)
    return m.select("doc_id", mk.count_references_col(F.col("text")).alias("count"))


@query("is_separate", f"SELECT doc_id, CASE WHEN regexp_matches({S.c2(S.c1('text'))}, '(?i)GCIT') THEN 0 ELSE 1 END AS separate "
       f"FROM ({S.MARKED})")
def q_is_separate(spark, sf_dir):
    """C7 1 when no group-target marker remains after grouping."""
    m = td.marked_corpus(spark, sf_dir)
    g = mk.group_citations_col(mk.mark_citations_col(F.col("text")))
    return m.select("doc_id", mk.is_separate_col(g).alias("separate"))


SQL_CITSTATS = (f"WITH s AS (SELECT doc_id, CAST(len(list_filter(string_split(regexp_replace(text, '(?i)<(CIT|OTH)>', 'REF', 'g'), ' '), "
                f"lambda w: regexp_matches(w, '(?i)REF'))) AS BIGINT) AS cnt, "
                f"CAST(CASE WHEN regexp_matches({S.c2(S.c1('text'))}, '(?i)GCIT') THEN 0 ELSE 1 END AS BIGINT) AS sep FROM ({S.MARKED})) "
                f"SELECT doc_id, 'Count' AS feature, cnt AS n FROM s WHERE cnt <> 0 UNION ALL "
                f"SELECT doc_id, 'Separate' AS feature, sep AS n FROM s WHERE sep <> 0")


@query("citation_stats", SQL_CITSTATS)
def q_citation_stats(spark, sf_dir):
    """E8/D13 Count and Separate as long document features."""
    return lx.citation_stats(td.marked_corpus(spark, sf_dir), MARKERS_CIT)


@query("count_histogram", f"SELECT {td.LABEL_SQL} AS label, CAST(len(list_filter(string_split(regexp_replace(d.text, '(?i)<(CIT|OTH)>', 'REF', 'g'), ' '), "
       f"lambda w: regexp_matches(w, '(?i)REF'))) AS INTEGER) AS count, count(*) AS n_docs "
       f"FROM ({S.MARKED}) d JOIN labels l ON d.doc_id = l.doc_id GROUP BY ALL")
def q_count_histogram(spark, sf_dir):
    """AG6 histogram data: documents per (class, reference count)."""
    m = td.marked_corpus(spark, sf_dir, labelled=True)
    return (m.select("label", mk.count_references_col(F.col("text")).alias("count"))
            .groupBy("label", "count").agg(F.count(F.lit(1)).alias("n_docs")))


# ===================================================== feature tables (D)
SQL_UNI_COUNTS_ALL_ = f"SELECT doc_id, lower(term) AS feature, count(*) AS n FROM ({S.explode(S.DOCS, S.word_tokens(**UNIGRAM_SQL_FLAGS))}) GROUP BY ALL"


@query("dfm_boolean", f"SELECT doc_id, feature, CAST(1 AS BIGINT) AS n FROM ({SQL_UNI_COUNTS_ALL_})")
def q_dfm_boolean(spark, sf_dir):
    """D3 boolean weights."""
    return ft.weight_boolean(unigram_counts(spark, sf_dir, labelled=False))


def sql_lookup(counts_sql: str, dictionary: dict, boolean=False) -> str:
    rows = [(k, glob_to_regex(p.lower())) for k, pats in dictionary.items() for p in pats]
    d = S.values(rows, ["key", "rx"])
    val = "CAST(1 AS BIGINT)" if boolean else "CAST(sum(n) AS BIGINT)"
    return (f"WITH c AS ({counts_sql}), m AS (SELECT DISTINCT c.doc_id, d.key, c.feature, c.n FROM c JOIN {d} d "
            f"ON regexp_matches(lower(c.feature), d.rx)) SELECT doc_id, key AS feature, {val} AS n FROM m GROUP BY doc_id, key")


LEXICON_PLAIN = lexicon_dictionary(SEM_NEGATION)
LEXICON_NT = lexicon_dictionary(SEM_NEGATION_WITH_NT)


@query("dfm_lookup", sql_lookup(f"SELECT doc_id, lower(term) AS feature, count(*) AS n FROM "
                                f"({S.explode(SQL_CLEAN, S.word_tokens())}) GROUP BY ALL", LEXICON_PLAIN))
def q_dfm_lookup(spark, sf_dir):
    """D4 dictionary lookup (pronoun and negation keys), counts."""
    toks = tk.explode_tokens(tk.tokenize_words(clean_corpus(spark, sf_dir)))
    return lx.lexicon_features(toks, LEXICON_PLAIN, boolean=False)


@query("dfm_group", f"SELECT label, feature, CAST(sum(n) AS BIGINT) AS n FROM ({SQL_UNI_COUNTS_LAB}) GROUP BY ALL")
def q_dfm_group(spark, sf_dir):
    """D5 documents collapsed to classes."""
    return ft.dfm_group(unigram_counts(spark, sf_dir))


SQL_FREQ = f"SELECT label, feature, CAST(sum(n) AS BIGINT) AS frequency, count(*) AS docfreq FROM ({SQL_UNI_COUNTS_LAB}) GROUP BY ALL"


@query("frequency_rank", f"SELECT * FROM (SELECT *, CAST(rank() OVER (PARTITION BY label ORDER BY frequency DESC) AS INTEGER) AS rank "
       f"FROM ({SQL_FREQ})) WHERE rank <= 100000")
def q_frequency_rank(spark, sf_dir):
    """D6 class frequency with min-tie rank (first 100000 ranks)."""
    return ft.rank_within(ft.frequency(unigram_counts(spark, sf_dir)), n=100000, ties="min")


@query("top_features", f"SELECT DISTINCT feature FROM (SELECT *, rank() OVER (PARTITION BY label ORDER BY frequency DESC) AS r "
       f"FROM ({SQL_FREQ})) WHERE r <= 1000")
def q_top_features(spark, sf_dir):
    """D8 per-class top 1000 by count, min ties, distinct features."""
    return ft.top_features(unigram_counts(spark, sf_dir), k=1000, ties="min")


@query("top_features_random", f"SELECT DISTINCT feature FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY frequency DESC, "
       f"md5(concat(feature, ':1'))) AS r FROM ({SQL_FREQ})) WHERE r <= 10000")
def q_top_features_random(spark, sf_dir):
    """D9 per-class first 10000 by count, seeded random ties."""
    return ft.top_features(unigram_counts(spark, sf_dir), k=10000, ties="random", seed=1)


@query("select_features", f"SELECT doc_id, feature, round(weight, 6) AS weight FROM ({sql_tfidf(SQL_UNI_COUNTS_LAB, S.LABELLED)}) "
       f"WHERE feature IN (SELECT feature FROM ({sql_dictionary_builder(SQL_UNI_COUNTS_LAB)}))")
def q_select_features(spark, sf_dir):
    """D10 tf-idf table restricted to the selected vocabulary."""
    counts = unigram_counts(spark, sf_dir, persist=True)
    n = n_docs(spark, sf_dir)
    w = ft.select_features(ft.tfidf(counts, n_docs=n), dictionary_vocab(counts, n))
    return w.select("doc_id", "feature", F.round("weight", 6).alias("weight"))


def sql_keyness(target: str, measure: str, counts_sql: str = SQL_UNI_COUNTS_LAB) -> str:
    g = f"SELECT label, feature, sum(n) AS n FROM ({counts_sql}) GROUP BY ALL"
    per = (f"SELECT feature, CAST(sum(CASE WHEN label = '{target}' THEN n ELSE 0 END) AS DOUBLE) AS n_target, "
           f"CAST(sum(CASE WHEN label <> '{target}' THEN n ELSE 0 END) AS DOUBLE) AS n_reference FROM ({g}) GROUP BY feature")
    if measure == "chi2":
        stat = ("CASE WHEN den = 0 THEN NULL ELSE (CASE WHEN a < e THEN -1 ELSE 1 END) * "
                "nn * pow(greatest(0.0, abs(a * d - b * c) - nn / 2), 2) / den END")
    else:
        stat = "CASE WHEN a > 0 THEN ln(a / e) END"
    return (f"WITH per AS ({per}), tot AS (SELECT sum(n_target) AS t, sum(n_reference) AS r FROM per), "
            f"x AS (SELECT feature, n_target, n_reference, n_target AS a, n_reference AS b, t - n_target AS c, r - n_reference AS d "
            f"FROM per CROSS JOIN tot), y AS (SELECT *, a + b + c + d AS nn, (a + b) * (c + d) * (a + c) * (b + d) AS den FROM x), "
            f"z AS (SELECT *, (a + b) * (a + c) / nn AS e FROM y) "
            f"SELECT feature, n_target, n_reference, round({stat}, 6) + 0.0 AS {measure} FROM z")


@query("keyness_chi2", sql_keyness("n", "chi2"))
def q_keyness_chi2(spark, sf_dir):
    """D16 chi-squared keyness of class n against the rest."""
    k = ft.keyness(ft.dfm_group(unigram_counts(spark, sf_dir)), "n", measure="chi2")
    return k.select("feature", "n_target", "n_reference", *_r6("chi2"))


@query("keyness_pmi", sql_keyness("o", "pmi"))
def q_keyness_pmi(spark, sf_dir):
    """D16 pointwise mutual information of class o against the rest."""
    k = ft.keyness(ft.dfm_group(unigram_counts(spark, sf_dir)), "o", measure="pmi")
    return k.select("feature", "n_target", "n_reference", *_r6("pmi"))


@query("keyness_head", f"SELECT feature, chi2 FROM ({sql_keyness('n', 'chi2')}) ORDER BY chi2 DESC NULLS LAST, feature LIMIT 10")
def q_keyness_head(spark, sf_dir):
    """D17 head of the keyness list (top 10 by chi2)."""
    k = ft.keyness(ft.dfm_group(unigram_counts(spark, sf_dir)), "n", measure="chi2")
    k = k.select("feature", F.round("chi2", 6).alias("chi2"))
    return k.orderBy(F.col("chi2").desc_nulls_last(), "feature").limit(10)


# ====================================================== annotation (E)
SQL_TAGS = f"SELECT doc_id, tid AS pos, lemma || '_' || upos AS term FROM ({SQL_ANNOT})"


@query("tagged_text", f"SELECT doc_id, string_agg(term, ' ' ORDER BY pos) AS text FROM ({SQL_TAGS}) GROUP BY doc_id")
def q_tagged_text(spark, sf_dir):
    """E6/AG1 lemma_UPOS tags joined in token order per document."""
    return px.tagged_text(annotations(spark, sf_dir))


SQL_CLOSEST_POS = f"""WITH tags AS ({SQL_TAGS}),
tg AS (SELECT doc_id, pos FROM tags WHERE regexp_matches(term, {sql_str(TARGET_RX_TAG)})),
cand AS (SELECT * FROM (SELECT doc_id, pos, term, CASE WHEN contains(term, '_VERB') THEN 'VERB' WHEN contains(term, '_ADJ') THEN 'ADJ'
         WHEN contains(term, '_ADV') THEN 'ADV' END AS cls FROM tags) WHERE cls IS NOT NULL),
pr AS (SELECT c.doc_id, c.cls, c.pos, c.term, min(abs(c.pos - t.pos)) AS d FROM cand c JOIN tg t ON c.doc_id = t.doc_id GROUP BY ALL),
best AS (SELECT doc_id, cls, regexp_replace(term, '_(VERB|ADJ|ADV)', '', 'g') AS closest FROM
         (SELECT *, row_number() OVER (PARTITION BY doc_id, cls ORDER BY d, pos) AS rn FROM pr) WHERE rn = 1),
docs AS (SELECT DISTINCT doc_id FROM tags),
cp AS (SELECT docs.doc_id, coalesce(max(CASE WHEN cls = 'VERB' THEN closest END), '') AS verb,
       coalesce(max(CASE WHEN cls = 'ADJ' THEN closest END), '') AS adj,
       coalesce(max(CASE WHEN cls = 'ADV' THEN closest END), '') AS adv
       FROM docs LEFT JOIN best ON docs.doc_id = best.doc_id GROUP BY docs.doc_id)"""


def closest_pos_df(spark, sf_dir, annot=None):
    tagged = px.tagged_tokens(annot if annot is not None else annotations(spark, sf_dir))
    return px.closest_pos(tagged, TARGET_RX_TAG)


@query("closest_pos", SQL_CLOSEST_POS + " SELECT * FROM cp")
def q_closest_pos(spark, sf_dir):
    """E1 closest verb / adjective / adverb to the target marker."""
    return closest_pos_df(spark, sf_dir)


@query("closest_dfm", SQL_CLOSEST_POS + """, tx AS (SELECT doc_id, list_filter(string_split(concat_ws(' ', verb, adj, adv), ' '),
       lambda x: x <> '') AS toks FROM cp)
       SELECT doc_id, lower(t) AS feature, count(*) AS n FROM (SELECT doc_id, unnest(toks) AS t FROM tx) GROUP BY ALL""")
def q_closest_dfm(spark, sf_dir):
    """E3 closest items as document features."""
    return lx.closest_dfm(closest_pos_df(spark, sf_dir), ["verb", "adj", "adv"])


SQL_WORDS = S.values([(w,) for w in td.TEST_SUBJECTIVE], ["word"])
SQL_CLOSEST_SUBJ = f"""WITH c AS ({SQL_CLEAN}),
t AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), ' ')) AS term, generate_subscripts(string_split(coalesce(text, ''), ' '), 1) AS pos FROM c),
tg AS (SELECT doc_id, pos FROM t WHERE regexp_matches(term, {sql_str(TARGET_RX_WORD)})),
cand AS (SELECT * FROM t WHERE term IN (SELECT word FROM {SQL_WORDS})),
pr AS (SELECT c.doc_id, c.pos, c.term, min(abs(c.pos - tg.pos)) AS d FROM cand c JOIN tg ON c.doc_id = tg.doc_id GROUP BY ALL),
best AS (SELECT doc_id, term FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY d, pos) AS rn FROM pr) WHERE rn = 1),
cs AS (SELECT c.doc_id, coalesce(best.term, '') AS closest FROM c LEFT JOIN best ON c.doc_id = best.doc_id)"""


def closest_subj_df(spark, sf_dir, clean=None):
    words = src.make_wordlist(spark, td.TEST_SUBJECTIVE)
    return px.closest_in_list(clean if clean is not None else clean_corpus(spark, sf_dir, dealt=True), words, TARGET_RX_WORD)


@query("closest_subjective", SQL_CLOSEST_SUBJ + " SELECT * FROM cs")
def q_closest_subjective(spark, sf_dir):
    """E2 closest word of a word list to the target marker."""
    return closest_subj_df(spark, sf_dir)


SQL_SUBJ_DFM = (SQL_CLOSEST_SUBJ + f", sd AS (SELECT doc_id, lower(term) AS feature, count(*) AS n FROM "
                f"({S.explode('SELECT doc_id, closest AS text FROM cs', S.word_tokens())}) GROUP BY ALL)")
SQL_LEXICON = sql_lookup(f"SELECT doc_id, lower(term) AS feature, count(*) AS n FROM "
                        f"({S.explode(SQL_CLEAN, S.word_tokens())}) GROUP BY ALL", LEXICON_NT, boolean=True)


def lexicon_presence(spark, sf_dir, clean=None):
    toks = tk.explode_tokens(tk.tokenize_words(clean if clean is not None else clean_corpus(spark, sf_dir, dealt=True)))
    return lx.lexicon_features(toks, LEXICON_NT, boolean=True)


@query("lexicon_features", SQL_LEXICON)
def q_lexicon_features(spark, sf_dir):
    """E4 pronoun / negation presence per document."""
    return lexicon_presence(spark, sf_dir)


SQL_MIN3_COUNTS = f"SELECT doc_id, lower(term) AS feature, count(*) AS n FROM ({SQL_MIN3_LONG}) GROUP BY ALL"
SQL_MIN3_PAIRS = (f"SELECT a.doc_id, lower(a.term || ' ' || b.term) AS feature, count(*) AS n FROM ({SQL_MIN3_LONG}) a "
                 f"JOIN ({SQL_MIN3_LONG}) b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 GROUP BY ALL")


@query("section_features", sql_lookup(f"{SQL_MIN3_COUNTS} UNION ALL {SQL_MIN3_PAIRS}", SECTIONS))
def q_section_features(spark, sf_dir):
    """E5 section keys on single tokens and adjacent pairs."""
    return lx.section_features(tk.explode_tokens(long_word_tokens(spark, sf_dir, dealt=True)), SECTIONS, phrases=True)


@query("dependency_features", f"""WITH a AS ({SQL_ANNOT}), tr AS (SELECT d.doc_id, d.relation || '_' || d.lemma || '_' || h.lemma AS term
       FROM a d JOIN a h ON d.doc_id = h.doc_id AND d.sid = h.sid AND d.tid_target = h.tid)
       SELECT doc_id, lower(term) AS feature, count(*) AS n FROM tr GROUP BY ALL""")
def q_dependency_features(spark, sf_dir):
    """E7/J5 dependency triples relation_lemma_headlemma as features."""
    return ft.dfm(px.dependency_triples(annotations(spark, sf_dir)))


@query("combine_features", f"""WITH {SQL_CLOSEST_SUBJ.strip()[5:]}, {SQL_SUBJ_DFM.split(', sd AS', 1)[1].join(['sd AS', ''])},
       lexf AS ({SQL_LEXICON}), cst AS ({SQL_CITSTATS})
       SELECT doc_id, feature, CAST(sum(n) AS BIGINT) AS n FROM (SELECT * FROM sd UNION ALL SELECT * FROM lexf UNION ALL SELECT * FROM cst)
       GROUP BY ALL""")
def q_combine_features(spark, sf_dir):
    """D11 citation statistics + lexicon + closest subjective word combined."""
    subj = lx.closest_dfm(closest_subj_df(spark, sf_dir), ["closest"], word_tokens=True)
    stats = lx.citation_stats(td.marked_corpus(spark, sf_dir), MARKERS_CIT)
    return ft.combine(stats, lexicon_presence(spark, sf_dir), subj)


# ================================================= predicates, joins (P, J)
@query("filter_any", "SELECT doc_id FROM labels WHERE quality = 1 OR toxic = 1")
def q_filter_any(spark, sf_dir):
    """P2 ids where any flag column equals 1."""
    return src.filter_any(td.table(spark, sf_dir, "labels"), ["quality", "toxic"], 1).select("doc_id")


@query("subset_docs", f"SELECT * FROM ({SQL_UNI_COUNTS_LAB}) WHERE label <> 'o'")
def q_subset_docs(spark, sf_dir):
    """P3 feature rows of non-neutral documents."""
    # The documents are chosen before their words are counted; they are read once, so nothing is kept.
    keep = td.labels(spark, sf_dir).filter(F.col("label") != "o").select("doc_id")
    docs = td.labelled_corpus(spark, sf_dir).select("doc_id", "label", "text").join(keep, "doc_id", "left_semi")
    return ft.dfm(unigram_tokens(by_document(docs), keep=("label",)), by=("doc_id", "label"))


@query("drop_features", f"SELECT * FROM ({SQL_UNI_COUNTS_LAB}) WHERE feature IS NOT NULL AND feature <> 'na'")
def q_drop_features(spark, sf_dir):
    """P6 drop missing features and the literal feature 'na'."""
    c = unigram_counts(spark, sf_dir)
    return c.filter(F.col("feature").isNotNull() & (F.col("feature") != "na"))


@query("semi_docs", f"SELECT DISTINCT doc_id FROM ({SQL_ANNOT}) WHERE doc_id IN (SELECT doc_id FROM labels)")
def q_semi_docs(spark, sf_dir):
    """P7/J4 annotated documents that are also labelled (semi join)."""
    a = annotations(spark, sf_dir).select("doc_id").distinct()
    return a.join(td.labels(spark, sf_dir), "doc_id", "left_semi")


@query("section_number", f"SELECT doc_id, text FROM ({SQL_CLEAN}) WHERE regexp_matches(text, '[0-9] \\p{{Lu}}')")
def q_section_number(spark, sf_dir):
    """P8 texts with a digit, a space and an upper-case letter."""
    return clean_corpus(spark, sf_dir).select("doc_id", "text").filter(F.col("text").rlike(r"[0-9] \p{Lu}"))


@query("derive_binary", f"SELECT doc_id, label, CAST(label = 'o' AS INTEGER) AS neutral FROM ({S.LABELLED})")
def q_derive_binary(spark, sf_dir):
    """P10 binary neutral label derived from the class."""
    lab = td.labelled_corpus(spark, sf_dir).select("doc_id", "label")
    return lab.withColumn("neutral", (F.col("label") == "o").cast("int"))


@query("with_labels_left", f"SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN {td.LABEL_SQL} END AS label "
       f"FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def q_with_labels_left(spark, sf_dir):
    """J2/D15 left key join re-attaching labels (unlabelled -> NULL)."""
    return ft.with_labels(td.corpus(spark, sf_dir).select("doc_id"), td.labels(spark, sf_dir), how="left")
