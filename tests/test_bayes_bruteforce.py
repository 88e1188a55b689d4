"""One-plan NB cross-validation equals a per-fold train/predict loop."""

import math
import random

import pytest

from textmine.operators import bayes as nb
from textmine.operators import folds as fo

CLASSES = ["n", "o", "p"]


def fixture(seed=3, n_docs=60, vocab=12):
    rnd = random.Random(seed)
    docs, counts = [], []
    for d in range(1, n_docs + 1):
        lab = rnd.choice(CLASSES)
        docs.append((d, lab))
        bias = CLASSES.index(lab) * 3
        for _ in range(rnd.randint(0, 6)):        # some documents have no feature
            counts.append((d, lab, f"w{(bias + rnd.randint(0, 5)) % vocab}", rnd.randint(1, 3)))
    agg = {}
    for d, lab, w, n in counts:
        agg[(d, lab, w)] = agg.get((d, lab, w), 0) + n
    return docs, [(d, lab, w, n) for (d, lab, w), n in agg.items()]


def brute_cv(docs, counts, folds, s):
    vocab = {w for _, _, w, _ in counts}
    v = len(vocab)
    fold_of = {(r, d): f for d, r, f in folds}
    label = dict(docs)
    by_doc = {}
    for d, _, w, n in counts:
        by_doc.setdefault(d, {})[w] = n
    out = []
    for (r, f) in sorted({(r, f) for _, r, f in folds}):
        train = [d for d, _ in docs if fold_of[(r, d)] != f]
        test = [d for d, _ in docs if fold_of[(r, d)] == f]
        nd = {c: sum(label[d] == c for d in train) for c in CLASSES}
        prior = {c: nd[c] / len(train) for c in CLASSES}
        nwc = {c: {} for c in CLASSES}
        for d in train:
            for w, n in by_doc.get(d, {}).items():
                nwc[label[d]][w] = nwc[label[d]].get(w, 0) + n
        tot = {c: sum(nwc[c].values()) for c in CLASSES}
        for d in test:
            best = None
            for i, c in enumerate(CLASSES):
                lp = math.log(prior[c]) if prior[c] > 0 else -math.inf
                for w, n in by_doc.get(d, {}).items():
                    lp += n * math.log((nwc[c].get(w, 0) + s) / (tot[c] + s * v))
                key = (round(lp, 6), prior[c], -i)
                if best is None or key > best[0]:
                    best = (key, c)
            out.append((r, float(s), f, d, label[d], best[1]))
    return sorted(out)


@pytest.mark.parametrize("smoothings", [(1.0,), (0.5, 2.0)])
def test_nb_cv_equals_per_fold_loop(spark, smoothings):
    docs, counts = fixture()
    ddf = spark.createDataFrame(docs, "doc_id long, label string")
    cdf = spark.createDataFrame(counts, "doc_id long, label string, feature string, n long")
    fdf = fo.assign_folds(ddf, k=5, seed=2, repeats=2)
    folds = [tuple(r) for r in fdf.select("doc_id", "repeat", "fold").collect()]
    got = sorted(tuple(r) for r in nb.nb_cross_validate(cdf, ddf, fdf, smoothings, classes=CLASSES).collect())
    want = sorted(sum((brute_cv(docs, counts, folds, s) for s in smoothings), []))
    assert got == want


def test_folds_are_near_equal_and_cover_all(spark):
    docs, _ = fixture(n_docs=53)
    ddf = spark.createDataFrame(docs, "doc_id long, label string")
    rows = fo.assign_folds(ddf, k=10, seed=1, repeats=3).collect()
    for r in (1, 2, 3):
        sizes = {}
        ids = set()
        for row in rows:
            if row.repeat == r:
                sizes[row.fold] = sizes.get(row.fold, 0) + 1
                ids.add(row.doc_id)
        assert ids == {d for d, _ in docs}
        assert sorted(sizes) == list(range(1, 11))
        assert max(sizes.values()) - min(sizes.values()) <= 1
