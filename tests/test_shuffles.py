"""What may be shuffled: texts and per-feature sums, not the cells of the documents, and not once a repeat."""

import os

import numpy as np
from pyspark.sql import functions as F

from textmine.operators import bayes as nb
from textmine.operators import features as ft
from textmine.operators import folds as fo
from textmine.operators import lexicon as lx
from textmine.operators.svm import model_specs
from textmine.operators.svm_primal import Blocks, block_sums, packed, unpacked
from textmine.operators.util import by_document
from textmine.plans.catalog import QUERIES
from textmine.plans.text_queries import annotations
from textmine.sources import testdata as td


def _counts(spark):
    rows = [(d, "npo"[d % 3], f"w{(d * 7 + j * j) % 23}", 1 + (d + j) % 3) for d in range(60) for j in range(6)]
    c = spark.createDataFrame(rows, "doc_id long, label string, feature string, n long")
    return c.groupBy("doc_id", "label", "feature").agg(F.sum("n").alias("n"))


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _without_broadcast_by_size(spark, make):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return make()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_a_small_vocabulary_does_not_shuffle_the_cells(spark):
    counts = _counts(spark)
    vocab = counts.filter("feature < 'w2'").select("feature")
    plan = _without_broadcast_by_size(spark, lambda: _plan(ft.select_features(counts, vocab)))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_repeats_do_not_shuffle_the_cells(spark):
    counts = _counts(spark).cache()
    docs = counts.select("doc_id", "label").distinct()
    folds = fo.assign_folds(docs, k=5, repeats=3)
    plan = _without_broadcast_by_size(
        spark, lambda: _plan(nb.nb_cross_validate(counts, docs, folds, (0.0, 1.0), classes=["n", "o", "p"])))
    joins = [line for line in plan.splitlines() if "SortMergeJoin" in line and "fold#" in line and "feature#" in line]
    assert not joins, joins


def test_class_frequencies_in_one_aggregate(spark):
    counts = _counts(spark).filter("not (label = 'n' and feature = 'w3')")
    two = ft.tfidf_class_frequency(counts, n_docs=60)
    one = ft.tfidf_class_frequency(counts, n_docs=60, classes=["n", "o", "p"])

    def rows(df):
        return sorted((r["label"], r["feature"], round(r["frequency"], 9)) for r in df.collect())
    assert rows(one) == rows(two)
    assert _plan(one).count("Join") == 0


def test_pairs_of_tokens_need_no_join_and_no_second_shuffle(spark):
    rows = [(1, 1, "are"), (1, 2, "This"), (1, 3, "not"), (1, 4, "so"), (2, 1, "are"), (2, 3, "this"), (3, 1, "are"), (3, 2, "this"), (3, 2, "this")]
    long = spark.createDataFrame(rows, "doc_id long, pos int, term string").repartition(3, "doc_id")
    found = lx.section_features(long, {"a": ["are this", "not *"], "b": ["this", "are"]})
    plan = _plan(found)
    # Of a position that occurs twice both words follow.
    assert sorted(tuple(r) for r in found.collect()) == [(1, "a", 2), (1, "b", 2), (2, "b", 2), (3, "a", 2), (3, "b", 3)]
    assert "Join" not in plan and plan.count("Exchange") == 1


def test_an_svm_pass_returns_one_gradient_a_core(spark):
    docs = spark.createDataFrame([(i, "np"[i % 2], [0], [1.0]) for i in range(40)], "doc_id long, label string, idx array<int>, val array<double>")
    folds = docs.select("doc_id", F.lit(1).alias("repeat"), (F.col("doc_id") % 2).cast("int").alias("fold"))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "300")
    try:
        blocks = Blocks(docs, folds, {"name": "linear", "dim": 1}, [], [1])
        parts = blocks.rdd.getNumPartitions()
        blocks.release()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert parts == spark.sparkContext.defaultParallelism


def test_cells_are_counted_where_their_document_is(spark):
    docs = spark.createDataFrame([(i, "a b a") for i in range(9)], "doc_id long, text string")
    long = by_document(docs).select("doc_id", F.explode(F.split("text", " ")).alias("term"))
    assert _plan(ft.dfm(long)).count("Exchange") == 1


def test_a_pass_leaves_nothing_on_the_drivers_disk(spark):
    dim = 300_000  # a gradient above the size at which Spark writes a task to the disk
    vec = spark.createDataFrame([(i, "np"[i % 2], [i], [1.0]) for i in range(8)], "doc_id long, label string, idx array<int>, val array<double>")
    folds = vec.select("doc_id", F.lit(1).alias("repeat"), (F.col("doc_id") % 2).cast("int").alias("fold"))
    machines = [dict(m, cost=1.0) for m in model_specs(["n", "p"], [(1, 0)])]
    blocks = Blocks(vec, folds, {"name": "linear", "dim": dim}, machines, [1])
    w = np.zeros((dim + 1, 1))
    blocks.sums(w, w, np.ones(1), 0.1)

    def held():
        return sorted(os.listdir(spark.sparkContext._temp_dir))
    before = held()
    losses, part = blocks.sums(w, w, np.ones(1), 0.1)
    blocks.release()
    assert held() == before
    # Fold 0 is left out: the other rows are all of class p, the second of the pair, and fall short by 1.
    assert np.allclose(losses, 4 * 0.95) and np.allclose(part[-1], 4.0)


def test_blocks_keep_sparse_rows_sparse():
    x = np.zeros((5, 40))
    x[1, 3] = x[4, 39] = 2.5
    kept = packed(x)
    assert len(kept[2]) == 2 and (unpacked(kept) == x).all() and isinstance(packed(x + 1), np.ndarray)


def test_a_gradient_of_some_machines_is_that_part_of_all():
    rng = np.random.default_rng(2)
    y = rng.integers(-1, 2, (30, 4)).astype(np.int8)
    block = None, packed(rng.normal(size=(30, 6))), y
    w = rng.normal(size=(6, 4))
    some = np.array([1, 3])
    losses, part = block_sums(block, w, None, np.ones(4), 0.1, None)
    losses_, part_ = block_sums(block, w[:, some], None, np.ones(2), 0.1, some)
    assert np.allclose(losses[:, some], losses_, rtol=1e-5) and np.allclose(part[:, some], part_, atol=1e-4)


def test_features_out_of_reach_are_not_counted_and_the_vocabulary_is_the_same(spark):
    rows = [(d, "npo"[d % 3], f"common{j}", 1 + (d + j) % 4) for d in range(90) for j in range(30) if (d * j) % 5 < 3]
    rows += [(d, "npo"[d % 3], f"rare {d} {j}", 1) for d in range(90) for j in range(40)]
    counts = spark.createDataFrame(rows, "doc_id long, label string, feature string, n long").cache()
    whole = ft.tfidf_class_frequency(counts, 90, classes=["n", "o", "p"])
    # Up to classes shorter than k; with few buckets rare features share theirs with common ones.
    for k, buckets in ((1, 512), (4, 1 << 16), (12, 512), (40, 1 << 16), (5000, 512)):
        some = ft.reachable_class_frequency(counts, 90, k, ["n", "o", "p"], buckets=buckets)
        got = {r[0] for r in ft.dictionary_builder(some, k).collect()}
        assert got == {r[0] for r in ft.dictionary_builder(whole, k).collect()}
        assert k != 4 or some.count() < whole.count() / 3


def _tables(spark, tmp_path, rows):
    """documents and labels of ``rows`` (doc_id, text, toxic, quality), which queries read."""
    docs = spark.createDataFrame([(r[0], r[1], "en", "web") for r in rows], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows if r[2] is not None], "doc_id long, toxic int, quality int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_neutral_documents_are_left_out_before_their_words_are_counted(spark, tmp_path):
    sf = _tables(spark, tmp_path, [(1, "one two two", 1, 0), (2, "three four", 0, 0), (3, "five", 0, 1), (4, "six", None, None)])
    kept = len(spark._jsc.getPersistentRDDs())
    out = QUERIES["subset_docs"](spark, sf)
    assert sorted(tuple(r) for r in out.collect()) == [(1, "n", "one", 1), (1, "n", "two", 2), (3, "p", "five", 1)]
    assert "InMemoryTableScan" not in _plan(out) and len(spark._jsc.getPersistentRDDs()) == kept
    lines = _plan(out).split("== Initial Plan ==")[-1].splitlines()
    joined, counted = (min(i for i, line in enumerate(lines) if word in line) for word in ("LeftSemi", "HashAggregate"))
    assert joined > counted  # the join feeds the count


def test_tfidf_counts_a_text_once_and_does_not_sort_the_cells(spark, tmp_path):
    sf = _tables(spark, tmp_path, [(i, f"all word{i % 3} word{i % 3}", 0, 1) for i in range(9)])
    out = _without_broadcast_by_size(spark, lambda: QUERIES["tfidf"](spark, sf))
    plan = _without_broadcast_by_size(spark, lambda: _plan(out))
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and plan.count("InMemoryTableScan") == 2
    got = sorted((r["doc_id"], r["feature"], r["n"], r["weight"]) for r in out.collect())
    weight = round((1 + np.log10(2)) * np.log10(3), 6)
    assert got == sorted(x for i in range(9) for x in ((i, "all", 1, 0.0), (i, f"word{i % 3}", 2, weight)))
    spark.catalog.clearCache()


def test_annotated_texts_of_a_selection_are_dealt_out_once(spark, tmp_path):
    sf = _tables(spark, tmp_path, [(i, f"some word{i} there", i % 2, 1) for i in range(6)])
    annot = annotations(spark, sf, of=td.labels(spark, sf))
    assert "InMemoryTableScan" in _plan(annot) and annot.select("doc_id").distinct().count() == 6
    spark.catalog.clearCache()


def test_texts_of_a_selection_are_cut_into_words_once(spark, tmp_path):
    sf = _tables(spark, tmp_path, [(1, "The words, at https://x.y some 12 there", 1, 0), (2, None, 1, 0), (3, "of", 0, 1), (4, "other words", None, None)])
    annot = annotations(spark, sf, of=td.labels(spark, sf))
    above = _plan(annot).split("== Initial Plan ==")[-1].split("InMemoryRelation")[0]
    assert "InMemoryTableScan" in above and "regexp_extract_all" not in above
    whole = annotations(spark, sf).filter("doc_id < 4")
    assert sorted(map(tuple, annot.collect())) == sorted(map(tuple, whole.collect())) and annot.count() == 4
    spark.catalog.clearCache()


def test_marker_tables_clean_the_labelled_texts_once(spark, tmp_path):
    sf = _tables(spark, tmp_path, [(i, f"In the case is word{i} not and was there we", i % 2, 1) for i in range(6)] + [(9, "we are not", None, None)])
    for name in ("marker_counts_table", "marker_table"):
        out = QUERIES[name](spark, sf)
        assert _plan(out).count("InMemoryTableScan") >= 3  # the lexicon's and both closest parts
        assert {r["doc_id"] for r in out.select("doc_id").collect()} == set(range(6))
        spark.catalog.clearCache()


def test_lexicon_words_alone_are_counted(spark):
    long = spark.createDataFrame([(1, 1, "We"), (1, 2, "we"), (1, 3, "other"), (2, 1, "it"), (2, 2, None)], "doc_id long, pos int, term string")
    out = lx.lexicon_features(long, {"FPP": ["we", "m?"], "TPP": ["it"]}, boolean=False)
    assert sorted(map(tuple, out.collect())) == [(1, "FPP", 2), (2, "TPP", 1)]
    lines = _plan(out).split("== Initial Plan ==")[-1].splitlines()
    assert max(i for i, line in enumerate(lines) if "Filter" in line and "RLIKE" in line) > max(i for i, line in enumerate(lines) if "HashAggregate" in line)


def test_the_ranking_makes_the_cells_once(spark):
    made = spark.sparkContext.accumulator(0)

    def cell(i):
        made.add(1)
        return i, "npo"[i % 3], f"w{i * i % 31}", 1 + i % 4

    cells = spark.sparkContext.parallelize(range(240), 4).map(cell)
    counts = spark.createDataFrame(cells, "doc_id long, label string, feature string, n long")
    got = {r[0] for r in ft.top_features(counts, k=5, ties="random").collect()}
    assert made.value == 240
    freq = ft.frequency(counts)
    assert got == {r["feature"] for r in ft.rank_within(freq, n=5, ties="random").collect()}
    spark.catalog.clearCache()


def test_a_kept_table_of_columns_is_found_in_a_join_with_itself(spark):
    wide = spark.createDataFrame([(1, 2, 0), (2, 5, 1), (3, None, 1)], "doc_id long, Count long, Separate long")
    long = ft.columns_to_dfm(wide, ["Count", "Separate"]).persist()
    assert sorted(map(tuple, long.collect())) == [(1, "Count", 2), (2, "Count", 5), (2, "Separate", 1), (3, "Separate", 1)]
    both = long.join(long.groupBy("feature").agg(F.count("*").alias("docs")), "feature")
    assert str(both._jdf.queryExecution().withCachedData().toString()).count("InMemoryRelation") == 2
    long.unpersist()
