"""Dual SVM solver against optimality conditions and an independent solver."""

import itertools
import random

import numpy as np
import pytest
from pyspark.ml.classification import LinearSVC
from pyspark.ml.linalg import SparseVector

from textmine.operators import svm as sv

CLASSES = ["n", "o", "p"]
DIM = 6


def fixture(seed=5, n_docs=90):
    rnd = random.Random(seed)
    rows = []
    for d in range(1, n_docs + 1):
        lab = CLASSES[d % 3]
        base = CLASSES.index(lab) * 2
        idx = sorted({base, base + 1, rnd.randrange(DIM)})
        val = [round(rnd.uniform(0.5, 2.0), 3) for _ in idx]
        rows.append((d, lab, idx, val, DIM, rnd.randint(1, 2)))
    return rows


def frames(spark, rows):
    vec = spark.createDataFrame([r[:5] for r in rows], "doc_id long, label string, idx array<int>, val array<double>, size int")
    folds = spark.createDataFrame([(r[0], 1, r[5]) for r in rows], "doc_id long, repeat int, fold int")
    return vec, folds


@pytest.mark.parametrize("kernel,cost", [("linear", 1.0), ("rbf", 100.0), ("rbf", 1000.0)])
def test_dual_reaches_the_optimum(kernel, cost):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 5))
    y = np.where(x[:, 0] + 0.5 * rng.normal(size=120) > 0, 1.0, -1.0)
    inner, norms = x @ x.T, (x**2).sum(axis=1)
    k = sv.kernel_values(inner, norms, norms, kernel, 0.2)
    alpha, objective, worst = sv.solve_dual(k, y, cost, 1e-6)
    assert worst < 1e-6 and (alpha >= 0).all() and (alpha <= cost).all()
    q = k * y[:, None] * y[None, :]
    assert objective == pytest.approx(0.5 * alpha @ q @ alpha - alpha.sum(), rel=1e-6)
    margin = y * (k @ (alpha * y))
    primal = 0.5 * (alpha * y) @ k @ (alpha * y) + cost * np.maximum(0, 1 - margin).sum()
    assert primal == pytest.approx(-objective, rel=1e-3)  # no duality gap


def test_kernel_blocks_equal_dense_products():
    rng = np.random.default_rng(4)
    x = np.where(rng.random((30, 5000)) < 0.01, rng.normal(size=(30, 5000)), 0.0)
    rows = sv.Rows([np.flatnonzero(r) for r in x], [r[r != 0] for r in x])
    assert np.allclose(sv.products(rows, rows, 5000), x @ x.T) and np.allclose(rows.norms, (x**2).sum(axis=1))


def test_equals_separate_fits(spark):
    rows = fixture()
    vec, folds = frames(spark, rows)
    got = {(r.fold, r.doc_id): r.predicted for r in sv.svm_cross_validate(vec, folds, CLASSES, cost=1.0, tol=1e-6).collect()}
    margins = {(r.fold, r.a, r.b, r.doc_id): r.margin for r in sv.svm_margins(vec, folds, CLASSES, cost=1.0, tol=1e-6).collect()}
    want = {}
    for f in (1, 2):
        test = [r for r in rows if r[5] == f]
        votes = {r[0]: [0, 0, 0] for r in test}
        for a, b in itertools.combinations(range(3), 2):
            train = [r for r in rows if r[5] != f and r[1] in (CLASSES[a], CLASSES[b])]

            def vec_of(r):
                return SparseVector(DIM + 1, list(r[2]) + [DIM], list(r[3]) + [1.0])

            x = np.array([vec_of(r).toArray() for r in train])
            y = np.array([1.0 if r[1] == CLASSES[a] else -1.0 for r in train])
            alpha, _, _ = sv.solve_dual(x @ x.T, y, 1.0, 1e-6)
            w = x.T @ (alpha * y)

            def primal(w, x=x, y=y):
                return 0.5 * w @ w + np.maximum(0, 1 - y * (x @ w)).sum()

            if (f, a, b) == (1, 0, 1):  # one fit of the other solver: it runs a job for each of its steps
                tdf = spark.createDataFrame([(vec_of(r), float(r[1] == CLASSES[a])) for r in train], ["features", "y"])
                m = LinearSVC(featuresCol="features", labelCol="y", regParam=1.0 / len(train), maxIter=25,
                              fitIntercept=False, standardization=False).fit(tdf)
                # it only comes near the optimum of the non-smooth hinge loss
                assert primal(w) <= primal(m.coefficients.toArray()) + 1e-6
            for r in test:
                margin = float(vec_of(r).toArray() @ w)
                assert abs(margin - margins[f, a, b, r[0]]) < 1e-4
                votes[r[0]][a if margin > 0 else b] += 1
        for d, v in votes.items():
            want[(f, d)] = CLASSES[max(range(3), key=lambda i: (v[i], -i))]
    assert got == want


def test_a_sample_of_all_rows_changes_nothing_and_a_smaller_one_still_judges_all(spark):
    rows = fixture()
    vec, folds = frames(spark, rows)
    full = sorted(map(tuple, sv.svm_cross_validate(vec, folds, CLASSES, kernel="rbf", cost=10.0).collect()))
    assert full == sorted(map(tuple, sv.svm_cross_validate(vec, folds, CLASSES, kernel="rbf", cost=10.0, max_rows=90).collect()))
    assert len(sv.svm_cross_validate(vec, folds, CLASSES, max_rows=40).collect()) == len(rows)


def test_svm_queries_shape(spark):
    import __spark_entry__ as E
    df = E.queries()["svm_linear_cv"](spark, "/root/testdata/sf0.001")
    rows = df.collect()
    assert len(rows) == 1 and rows[0].n_folds == 10
    for c in ("macro_f1", "micro_f1", "weighted_f1"):
        assert 0.0 <= rows[0][c] <= 1.0
