"""Closest tags across sentences."""

import random

from pyspark.sql import functions as F

from textmine.operators import proximity as px


def test_distances_run_across_sentences(spark):
    # the target ends sentence 1; "show" is the next token, "see" four before
    words = [(1, 1, "see", "VERB"), (1, 2, "a", "X"), (1, 3, "b", "X"), (1, 4, "c", "X"), (1, 5, "CIT", "X"),
             (2, 1, "show", "VERB"), (2, 2, "new", "ADJ")]
    annot = spark.createDataFrame([(7, s, t, w, w, u) for s, t, w, u in words],
                                  "doc_id long, sid int, tid int, word string, lemma string, upos string")
    row = px.closest_pos(px.tagged_tokens(annot), "(?i)(CIT|GCIT)(SYN)*_").collect()[0]
    assert (row.verb, row.adj, row.adv) == ("show", "new", "")


def test_closest_candidate_equals_all_pairs(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for d in range(120):
        terms = [rng.choice(["CIT", "see", "new", "x", "y", "CIT_see"]) for _ in range(rng.randint(1, 30))]
        rows += [(d, i, t) for i, t in enumerate(terms)]
        targets = [i for i, t in enumerate(terms) if t.startswith("CIT")]
        cands = [i for i, t in enumerate(terms) if t in ("see", "new", "CIT_see")]
        if targets and cands:
            want[d] = terms[min(cands, key=lambda c: (min(abs(c - t) for t in targets), c))]
    long = spark.createDataFrame(rows, "doc_id long, pos int, term string").repartition(5, "pos")
    key = F.when(F.col("term").isin("see", "new", "CIT_see"), F.lit("w"))
    got = {r.doc_id: r.closest for r in px.nearest(long, key, F.col("term").startswith("CIT")).collect()}
    assert got == want


def test_heads_stay_inside_their_sentence_and_ids_may_have_gaps(spark):
    words = [(1, 1, 1, "we", "nsubj", 2), (1, 1, 2, "show", "root", 0), (1, 1, 3, "it", "obj", 2),
             (1, 2, 1, "see", "root", 0), (1, 2, 4, "this", "obj", 1), (1, 2, 9, "new", "amod", 4), (1, 2, 12, "lost", "dep", 7),
             (2, 1, 1, "alone", "root", 0)]
    annot = spark.createDataFrame(words, "doc_id long, sid int, tid int, lemma string, relation string, tid_target int")
    got = {(r.doc_id, r.pos.sid, r.pos.tid, r.term) for r in px.dependency_triples(annot).collect()}
    assert got == {(1, 1, 1, "nsubj_we_show"), (1, 1, 3, "obj_it_show"), (1, 2, 4, "obj_this_see"), (1, 2, 9, "amod_new_this")}
    assert px.dependency_triples(annot.limit(0)).count() == 0


def test_documents_without_target_or_candidate_have_empty_columns(spark):
    annot = spark.createDataFrame([(1, 1, 1, "a", "a", "X"), (2, 1, 1, "CIT", "CIT", "X"), (3, 1, 1, "see", "see", "VERB")],
                                  "doc_id long, sid int, tid int, word string, lemma string, upos string")
    out = px.closest_pos(px.tagged_tokens(annot), "(?i)CIT_").collect()
    assert {(r.doc_id, r.verb, r.adj, r.adv) for r in out} == {(1, "", "", ""), (2, "", "", ""), (3, "", "", "")}
