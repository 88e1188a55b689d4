"""Token operators against plain-Python brute force on small fixtures."""

import fnmatch
import random

import pytest
from pyspark.sql import functions as F

from textmine.functions.lexicons import NEGATION_PATTERNS, NEGATION_WINDOW
from textmine.operators import tokens as tk

DOCS = [
    (1, "I do not like this at all , really".split()),
    (2, "Not".split()),                                          # negator without its extra token
    (3, "nothing here . we can not say no one knows no way out".split()),
    (4, "It isn't good but never mind , it is fine fine fine".split()),
    (5, []),
    (6, ("alpha " * 20 + "not beta " + "gamma " * 20 + "NO delta epsilon").split()),
    (7, "cannot cannot cannot".split()),
    (8, "like this is fine".split()),
]


def _patterns():
    return [[w.lower() for w in p.split()[:-1]] for p in NEGATION_PATTERNS]


def brute_negation(docs, mode, window=NEGATION_WINDOW, suffix="_neg"):
    pats = _patterns()
    flags = {}
    for doc_id, toks in docs:
        low = [t.lower() for t in toks]
        n = len(toks)
        starts = []
        for p in range(n):
            best = -1
            for words in pats:
                m = len(words)
                if p + m < n and all(fnmatch.fnmatchcase(low[p + j], words[j]) for j in range(m)):
                    best = max(best, m)
            if best >= 0:
                starts.append((p, best))
        in_span = [any(q <= i <= q + m + window for q, m in starts) for i in range(n)]
        is_match = [any(q <= i <= q + m for q, m in starts) for i in range(n)]
        flags[doc_id] = (toks, in_span, is_match)
    tagset = {t for toks, sp, mt in flags.values() for t, s, m in zip(toks, sp, mt) if s and not m}
    out = []
    for doc_id, (toks, sp, mt) in flags.items():
        for i, t in enumerate(toks):
            tag = (sp[i] and not mt[i]) if mode == "window" else (sp[i] and t in tagset)
            out.append((doc_id, i + 1, t + suffix if tag else t))
    return sorted(out)


@pytest.mark.parametrize("mode", ["window", "corpus"])
def test_negation_matches_brute_force(spark, mode):
    df = spark.createDataFrame(DOCS, "doc_id long, tokens array<string>")
    got = sorted(tuple(r) for r in tk.tag_negation(df, mode=mode).select("doc_id", "pos", "term").collect())
    assert got == brute_negation(DOCS, mode)


def test_negation_short_window(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, tokens array<string>")
    got = sorted(tuple(r) for r in tk.tag_negation(df, window=2, mode="window").collect())
    assert got == brute_negation(DOCS, "window", window=2)


def test_ngrams_match_brute_force(spark):
    rnd = random.Random(7)
    rows = [(i, [rnd.choice("abcde") for _ in range(rnd.randint(0, 7))]) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, tokens array<string>")
    got = {r.doc_id: r.tokens for r in tk.ngrams(df, ns=(1, 2, 3)).collect()}
    for i, toks in rows:
        want = [ "_".join(toks[p:p + n]) for n in (1, 2, 3) for p in range(len(toks) - n + 1)]
        assert got[i] == want


def test_collect_tokens_restores_order(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, tokens array<string>")
    back = tk.collect_tokens(tk.explode_tokens(df))
    got = {r.doc_id: r.tokens for r in back.collect()}
    assert got == {d: t for d, t in DOCS if t}


def test_word_tokens_switches(spark):
    df = spark.createDataFrame([(1, "Costs 1,000.50 $ at https://x.org/a, it's well-known!")], "doc_id long, text string")
    toks = tk.tokenize_words(df, remove_numbers=True, remove_punct=True, remove_symbols=True, remove_url=True)
    assert toks.select("tokens").first()[0] == ["Costs", "at", "it's", "well-known"]
    keep = tk.tokenize_words(df).select(F.size("tokens")).first()[0]
    assert keep > 4
