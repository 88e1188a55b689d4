"""Support vector machines (D14, K6–K10): exact kernel machines on a bounded sample.

A cross-validation needs one binary machine for each (repeat, fold, class
pair or stage).  They share one training sample: the ``MAX_TRAIN_ROWS``
labelled documents that come first by a hash of their id (all of them, when
there are fewer).  Its kernel matrix is computed once, in row blocks on the
executors; every machine is then a task of its own that solves the dual

    min 1/2 a'Qa - sum(a),  0 <= a_i <= cost,  Q_ij = y_i y_j (k(x_i, x_j) + 1)

(hinge loss; the bias is a feature of value 1) by coordinate descent until no
coordinate violates optimality by ``tol`` or more.  There is no iteration
limit that returns an unfinished fit: a fit that stops making progress raises.
Scoring is one pass over all documents: a batch's kernel against the sample,
times the coefficients of all machines; nothing is replicated per machine.

Only the sample (bounded), its kernel matrix (bounded by the square of the
sample) and the coefficients pass through the driver.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmine.functions.text import array_lit
from textmine.operators.features import vocabulary_index
from textmine.operators.util import broadcast_if_small, scalar
from textmine.session import cut_lineage

MAX_TRAIN_ROWS = 4000   # labelled rows a fit may use: the kernel matrix has its square
ROW_BLOCK = 256         # rows of the kernel matrix that one task computes
WIDTH = 2048            # columns made dense at a time
TOL = 1e-3              # optimality violation at which a fit ends (the usual default of such solvers)


# ------------------------------------------------------------------ D14
def to_vectors(weights: DataFrame, docs: DataFrame, vocab: DataFrame | None = None,
               value_col="weight") -> DataFrame:
    """``(doc_id, label, idx, val, size)``, sparse and sorted by index;
    documents without a feature get an empty vector.  One group per document
    (bounded by the selected vocabulary)."""
    vocab = vocab if vocab is not None else weights.select("feature").distinct()
    index = vocabulary_index(vocab).persist(StorageLevel.MEMORY_AND_DISK)
    size = scalar(index.agg(F.max("size").alias("s")), "s") or 0
    index = broadcast_if_small(index.select("feature", "idx"))  # as in select_features
    cells = weights.select("doc_id", "feature", F.col(value_col).cast("double").alias("v")).join(index, "feature")
    per_doc = cells.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("idx", "v"))).alias("_e"))
    out = docs.select("doc_id", "label").join(per_doc, "doc_id", "left")
    idx = F.coalesce(F.transform("_e", lambda s: s["idx"]), F.array().cast("array<int>"))
    val = F.coalesce(F.transform("_e", lambda s: s["v"]), F.array().cast("array<double>"))
    return out.select("doc_id", "label", idx.alias("idx"), val.alias("val"), F.lit(int(size)).alias("size"))


# ------------------------------------------------------------ sparse rows
class Rows:
    """Sparse rows as sorted (column, row, value) triples."""

    def __init__(self, idx, val):
        lengths = [len(i) for i in idx]
        self.n = len(lengths)
        row = np.repeat(np.arange(self.n), lengths)
        col = np.concatenate([*map(np.asarray, idx), np.zeros(0)]).astype(np.int64)
        value = np.concatenate([*map(np.asarray, val), np.zeros(0)]).astype(np.float64)
        self.norms = np.bincount(row, weights=value**2, minlength=self.n)
        order = np.argsort(col, kind="stable")
        self.row, self.col, self.value = row[order], col[order], value[order]

    def dense(self, start: int) -> np.ndarray:
        lo, hi = np.searchsorted(self.col, [start, start + WIDTH])
        out = np.zeros((self.n, WIDTH))
        out[self.row[lo:hi], self.col[lo:hi] - start] = self.value[lo:hi]
        return out


def products(left: Rows, right: Rows, dim: int) -> np.ndarray:
    """All inner products, over slices of the columns."""
    out = np.zeros((left.n, right.n))
    for start in range(0, dim, WIDTH):
        out += left.dense(start) @ right.dense(start).T
    return out


def kernel_values(inner: np.ndarray, left: np.ndarray, right: np.ndarray, kernel: str, gamma: float) -> np.ndarray:
    """K6 ``rbf`` exp(-gamma |x - y|^2) or K7 ``linear``, plus 1 for the bias."""
    if kernel == "linear":
        return inner + 1.0
    return np.exp(-gamma * np.maximum(left[:, None] + right[None, :] - 2.0 * inner, 0.0)) + 1.0


# ------------------------------------------------------------------ K6/K7
def solve_dual(k: np.ndarray, y: np.ndarray, cost: float, tol: float = TOL):
    """Coefficients, objective and largest violation of one C-SVM with kernel matrix ``k``.

    Each step moves the coordinate that violates optimality most to its
    optimum.  Raises when the objective no longer falls but the violation is
    still ``tol`` or more.
    """
    n = len(y)
    alpha, grad = np.zeros(n), -np.ones(n)
    q = k * y[:, None] * y[None, :]
    diagonal = np.maximum(np.diag(q).copy(), 1e-12)
    objective, checked = 0.0, np.inf
    for step in itertools.count():
        violation = np.where(alpha <= 0, np.minimum(grad, 0), np.where(alpha >= cost, np.maximum(grad, 0), grad))
        i = int(np.argmax(violation**2 / diagonal)) if n else 0
        worst = float(np.abs(violation).max(initial=0.0))
        if worst < tol:
            return alpha, objective, worst
        new = min(max(alpha[i] - grad[i] / diagonal[i], 0.0), cost)
        move = new - alpha[i]
        objective += move * grad[i] + 0.5 * diagonal[i] * move * move
        alpha[i] = new  # exactly on a bound, when it is one
        grad += move * q[i]
        if step % (100 * n + 100) == 0:
            if checked - objective <= 1e-12 * max(1.0, abs(objective)):
                raise RuntimeError(f"fit stopped at violation {worst:g}, tolerance {tol:g}")
            checked = objective


# ------------------------------------------------------------ model specs
def model_specs(classes: list, folds: list[tuple[int, int]], scheme="ovo", neutral=None):
    """One spec per model: (model_id, repeat, fold, kind, pos, members).

    kind 'pair' (one-vs-one a|b), 'rest' (one-vs-rest), 'stage1' (neutral
    vs rest), 'stage2' (pairs among the other classes, trained on truly
    non-neutral rows)."""
    specs = []

    def add(r, f, kind, pos, members, a=-1, b=-1):
        specs.append(dict(model_id=len(specs), repeat=r, fold=f, kind=kind, pos=list(pos),
                          members=list(members), a=a, b=b))

    for r, f in folds:
        if neutral is not None:
            add(r, f, "stage1", [neutral], classes)
            polar = [c for c in classes if c != neutral]
            for a, b in itertools.combinations(range(len(polar)), 2):
                add(r, f, "stage2", [polar[a]], [polar[a], polar[b]], classes.index(polar[a]), classes.index(polar[b]))
        elif scheme == "ovo":
            for a, b in itertools.combinations(range(len(classes)), 2):
                add(r, f, "pair", [classes[a]], [classes[a], classes[b]], a, b)
        elif scheme == "ovr":
            for i, c in enumerate(classes):
                add(r, f, "rest", [c], classes, i, -1)
        else:
            raise ValueError("scheme must be 'ovo' or 'ovr'")
    return specs


def training_sample(vectors: DataFrame, folds: DataFrame, max_rows: int = MAX_TRAIN_ROWS):
    """The bounded sample: (rows, labels, {repeat: fold of each row}) of the
    ``max_rows`` labelled documents that come first by md5 of their id."""
    keys = vectors.select("doc_id").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(max_rows)
    picked = vectors.join(F.broadcast(keys), "doc_id", "left_semi").select("doc_id", "label", "idx", "val").toPandas()
    picked = picked.sort_values("doc_id").reset_index(drop=True)
    fold = folds.join(F.broadcast(keys), "doc_id", "left_semi").toPandas()
    place = pd.Series(np.arange(len(picked)), index=picked["doc_id"])
    by_repeat = {}
    for repeat, part in fold.groupby("repeat"):
        at = np.full(len(picked), -1)
        at[place[part["doc_id"]].to_numpy()] = part["fold"].to_numpy()
        by_repeat[int(repeat)] = at
    return Rows(picked["idx"], picked["val"]), picked["label"].to_numpy(), by_repeat


def sample_kernel(spark, rows, dim: int, kernel: str, gamma: float) -> np.ndarray:
    """Kernel matrix of the sample, in row blocks computed by the executors."""
    n = rows.value.n
    starts = range(0, n, ROW_BLOCK)

    def run(frames):
        own = rows.value
        for frame in frames:
            for start in frame["id"] * ROW_BLOCK:
                inside = (own.row >= start) & (own.row < start + ROW_BLOCK)
                block = Rows([], [])
                block.n = min(ROW_BLOCK, own.n - start)
                block.row, block.col, block.value = own.row[inside] - start, own.col[inside], own.value[inside]
                inner = products(block, own, dim)
                made = kernel_values(inner, own.norms[start:start + block.n], own.norms, kernel, gamma)
                yield pd.DataFrame({"start": [start], "k": [made.tobytes()]})

    out = np.zeros((n, n))
    blocks = spark.range(len(starts)).repartition(max(1, len(starts)), "id").mapInPandas(run, "start long, k binary")
    for row in blocks.collect():
        block = np.frombuffer(row.k).reshape(-1, n)
        out[row.start:row.start + len(block)] = block
    return out


def fit_models(spark, sample, specs: list, dim: int, cost: float, kernel: str, gamma: float, tol: float = TOL):
    """Signed coefficients (sample rows x machines) and a report (m, objective, violation) of every machine."""
    rows, labels, by_repeat = sample
    sent_rows = spark.sparkContext.broadcast(rows)
    k = spark.sparkContext.broadcast((sample_kernel(spark, sent_rows, dim, kernel, gamma), labels, by_repeat))

    def run(frames):
        matrix, lab, folds = k.value
        for frame in frames:
            for m in frame["id"]:
                s = specs[m]
                use = np.flatnonzero((folds[s["repeat"]] != s["fold"]) & (folds[s["repeat"]] >= 0) & np.isin(lab, s["members"]))
                y = np.where(np.isin(lab[use], s["pos"]), 1.0, -1.0)
                alpha, objective, worst = solve_dual(matrix[np.ix_(use, use)], y, cost, tol)
                held = alpha > 0
                yield pd.DataFrame({"m": [m], "row": [use[held].tolist()], "coef": [(alpha * y)[held].tolist()],
                                    "objective": [objective], "violation": [worst]})

    n = len(specs)
    fits = spark.range(n).repartition(max(1, n), "id").mapInPandas(
        run, "m long, row array<long>, coef array<double>, objective double, violation double")
    coef = np.zeros((rows.n, n))
    report = []
    for r in fits.collect():
        coef[r.row, r.m] = r.coef
        report.append((r.m, r.objective, r.violation))
    k.unpersist()
    return coef, sorted(report)


def score_margins(vectors: DataFrame, folds: DataFrame, sample, coef: np.ndarray, specs: list, dim: int,
                  kernel: str, gamma: float) -> DataFrame:
    """Test margins ``(repeat, fold, m, kind, a, b, doc_id, actual, margin)`` of all documents."""
    spark = vectors.sparkSession
    own = folds.groupBy("doc_id").agg(F.collect_list(F.struct("repeat", "fold")).alias("folds"))
    data = vectors.select("doc_id", "label", "idx", "val").join(own, "doc_id")
    sent = spark.sparkContext.broadcast((sample[0], coef))
    models: dict = {}
    for s in specs:
        models.setdefault((s["repeat"], s["fold"]), []).append(s)

    def run(frames):
        rows, weights = sent.value
        for frame in frames:
            for at in range(0, len(frame), ROW_BLOCK):
                part = frame.iloc[at:at + ROW_BLOCK]
                batch = Rows(part["idx"], part["val"])
                margin = kernel_values(products(batch, rows, dim), batch.norms, rows.norms, kernel, gamma) @ weights
                out = [(f["repeat"], f["fold"], s["model_id"], s["kind"], s["a"], s["b"], doc, label, margin[i, s["model_id"]])
                       for i, (doc, label, fs) in enumerate(zip(part["doc_id"], part["label"], part["folds"], strict=True))
                       for f in fs for s in models[f["repeat"], f["fold"]]]
                yield pd.DataFrame(out, columns=["repeat", "fold", "m", "kind", "a", "b", "doc_id", "actual", "margin"])

    types = dict(vectors.dtypes)
    return data.mapInPandas(run, f"repeat int, fold int, m int, kind string, a int, b int, doc_id {types['doc_id']}, "
                                 f"actual {types['label']}, margin double")


def _pick(classes, idx_col):
    return F.element_at(array_lit(classes), idx_col + 1)


def combine_votes(margins: DataFrame, classes: list, scheme="ovo", neutral=None) -> DataFrame:
    """Turn test margins into ``(repeat, fold, doc_id, actual, predicted)``:
    one-vs-one votes (ties to the first class), one-vs-rest arg-max, or the
    two-stage rule (stage 1 positive -> neutral, else stage-2 vote)."""
    keys = ["repeat", "fold", "doc_id", "actual"]
    if neutral is None and scheme == "ovr":
        best = margins.groupBy(*keys).agg(F.max(F.struct("margin", (-F.col("a")).alias("o"))).alias("_b"))
        return best.select(*keys, _pick(classes, -F.col("_b.o")).alias("predicted"))
    pairs = margins.filter(F.col("kind").isin("pair", "stage2"))
    votes = pairs.select(*keys, F.when(F.col("margin") > 0, F.col("a")).otherwise(F.col("b")).alias("w"))
    tally = votes.groupBy(*keys, "w").agg(F.count(F.lit(1)).alias("n"))
    best = tally.groupBy(*keys).agg(F.max(F.struct("n", (-F.col("w")).alias("o"))).alias("_b"))
    voted = best.select(*keys, _pick(classes, -F.col("_b.o")).alias("predicted"))
    if neutral is None:
        return voted
    s1 = margins.filter(F.col("kind") == "stage1").select(*keys, (F.col("margin") > 0).alias("_neutral"))
    out = s1.join(voted, keys, "left")
    return out.select(*keys, F.when(F.col("_neutral"), F.lit(neutral)).otherwise(F.col("predicted")).alias("predicted"))


# ------------------------------------------------------------------ K10
def svm_margins(vectors: DataFrame, folds: DataFrame, classes: list, cost=1.0, kernel="linear", scheme="ovo",
                neutral=None, gamma=None, max_rows: int = MAX_TRAIN_ROWS, tol: float = TOL) -> DataFrame:
    """K6/K7/K9: margins of every test document under every machine of its folds."""
    if kernel not in ("linear", "rbf"):
        raise ValueError("kernel must be 'linear' or 'rbf'")
    vectors = cut_lineage(vectors)  # one vector per document: read by the sample and by the scoring
    dim = scalar(vectors.agg(F.max("size").alias("s")), "s") or 0
    gamma = gamma if gamma is not None else 1.0 / max(1, dim)   # 1 / number of features
    keys = [tuple(r) for r in folds.select("repeat", "fold").distinct().orderBy("repeat", "fold").collect()]
    specs = model_specs(classes, keys, scheme, neutral)
    sample = training_sample(vectors, folds, max_rows)
    coef, _ = fit_models(vectors.sparkSession, sample, specs, dim, cost, kernel, gamma, tol)
    return score_margins(vectors, folds, sample, coef, specs, dim, kernel, gamma)


def svm_cross_validate(vectors: DataFrame, folds: DataFrame, classes: list, cost=1.0, kernel="linear",
                       scheme="ovo", neutral=None, gamma=None, max_rows: int = MAX_TRAIN_ROWS,
                       tol: float = TOL) -> DataFrame:
    """K7/K9/K10 (linear) and K6 (rbf): k-fold cross-validated predictions
    ``(repeat, fold, doc_id, actual, predicted)``."""
    margins = svm_margins(vectors, folds, classes, cost, kernel, scheme, neutral, gamma, max_rows, tol)
    return combine_votes(margins, classes, scheme, neutral).select("repeat", "fold", "doc_id", "actual", "predicted")


def svm_fit_predict(train_vectors: DataFrame, test_vectors: DataFrame, classes: list, cost=1.0, kernel="linear",
                    scheme="ovo", neutral=None, gamma=None) -> DataFrame:
    """K7/K8 single train/test split: ``(doc_id, actual, predicted)``."""
    tr = train_vectors.select("doc_id", "label", "idx", "val", "size")
    te = test_vectors.select("doc_id", "label", "idx", "val", "size")
    folds = te.select("doc_id", F.lit(1).alias("repeat"), F.lit(1).alias("fold")).unionByName(
        tr.select("doc_id", F.lit(1).alias("repeat"), F.lit(2).alias("fold")))
    pred = svm_cross_validate(tr.unionByName(te), folds, classes, cost, kernel, scheme, neutral, gamma)
    return pred.filter(F.col("fold") == 1).select("doc_id", "actual", "predicted")
