"""Quality classifier by compression.

Two zstandard dictionaries are built, from good and from bad labelled text.  A
text compressed with the dictionary of its own kind comes out smaller; the
difference of the two sizes, divided by the size without dictionary, over the
whole text and in its worst block, and how far the text compresses by itself
are turned into a probability by a logistic calibration.

Labels are used from training rows only (``crc32(doc_id as text) mod 3`` is not
1).  The sample is bounded by documented parameters: the ``per_class`` training
rows of each label that come first in the order of a hash of their id, and of
each at most ``sample_chars`` characters from a place that the hash picks.  One
half of it (by another bit of the hash) builds the dictionaries, the other half
fits the calibration.  Every row of the table is scored on its whole text.

Defined cases: a null or empty text is scored like a text whose sizes do not
differ; a row without id is scored, and not held out; a label table without
rows of one class gives that class's share as the score of every text (0.5 if
there are no labels at all); repeated label rows of an id count as one (the
smaller label); ties of the hash are ordered by id; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmine.llm.common import read_table

PER_CLASS = 4000
SAMPLE_CHARS = 3000
DICT_BYTES = 65_536
LEVEL = 3
BLOCK_BYTES = 2048
N_FEATURES = 4
FOLDS, HELD_OUT = 3, 1


def held_out(key):
    """Whether a row's id belongs to the held-out third (never for a null id)."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, key: str, text: str, per_class: int, sample_chars: int) -> tuple[list, dict]:
    """Bounded training sample (label, builds the dictionary, piece of text) in a fixed order; rows of each label."""
    lab = labels.filter(F.col(key).isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col(key)))
    lab = lab.groupBy(key).agg(F.min("quality").alias("quality")).withColumn("h", F.xxhash64(F.lit("sample"), F.col(key)))
    picked = None
    for label in (0, 1):  # two bounded top-k scans of ids, no text
        top = lab.filter(F.col("quality") == label).orderBy("h", key).limit(per_class)
        picked = top if picked is None else picked.unionByName(top)
    n = F.length(text)
    place = F.when(n > sample_chars, F.pmod(F.col("h"), n - sample_chars + 1) + 1).otherwise(F.lit(1)).cast("int")
    rows = docs.select(key, text).join(F.broadcast(picked), key).select(
        key, "h", "quality", F.substring(text, place, F.lit(sample_chars)).alias("piece"))
    rows = rows.filter(F.length("piece") > 0).dropDuplicates([key])
    sizes = {r.quality: r["count"] for r in lab.groupBy("quality").count().collect()}
    return [(r.quality, bool((r.h >> 7) & 1), r.piece) for r in sorted(rows.collect(), key=lambda r: (r.h, r[key]))], sizes


def _features(raw: bytes, plain, good, bad) -> tuple[float, ...]:
    """Normalised size difference of the whole text and of its worst block, and plain size by length.

    Blocks of ``BLOCK_BYTES`` are compressed apart: within a long text the text
    itself would soon replace the dictionary as context.
    """
    whole = gain = 0
    worst = 1.0
    for i in range(0, len(raw), BLOCK_BYTES):
        block = raw[i:i + BLOCK_BYTES]
        size = len(plain.compress(block))
        more = len(bad.compress(block)) - len(good.compress(block))
        whole += size
        gain += more
        if i == 0 or len(block) * 4 >= BLOCK_BYTES:
            worst = min(worst, more / size)
    if not whole:
        return 0.0, 0.0, 0.5, 0.0
    return gain / whole, worst, whole / (len(raw) + 16.0), float(np.log1p(min(len(raw), BLOCK_BYTES)))


class Model:
    """Two dictionaries and a logistic calibration; small and picklable."""

    def __init__(self, dictionaries, mean, scale, weights, prior):
        self.dictionaries, self.mean, self.scale, self.weights, self.prior = dictionaries, mean, scale, weights, prior

    def compressors(self):
        import zstandard

        made = [zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)]
        for raw in self.dictionaries:
            data = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=LEVEL)
            made.append(zstandard.ZstdCompressor(dict_data=data, write_content_size=False))
        return made

    def scores(self, features: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(features), self.prior)
        z = _expand((features - self.mean) / self.scale) @ self.weights
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def _expand(x: np.ndarray) -> np.ndarray:
    """Constant, features and their second-order terms."""
    pairs = [x[:, i] * x[:, j] for i in range(x.shape[1]) for j in range(i, x.shape[1])]
    return np.column_stack([np.ones(len(x)), x, *pairs])


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps to convergence."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ ((p - y) * weight) + ridge * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _dictionary(texts: list[bytes], size: int) -> bytes:
    """Raw-content dictionary: equal shares, from the middle, of all sample texts; what short texts leave goes to the others."""
    parts, left = [], size
    for k, t in enumerate(sorted(texts, key=len)):
        share = max(1, left // (len(texts) - k) - 1)
        parts.append(t[max(0, (len(t) - share) // 2):][:share])
        left -= len(parts[-1]) + 1
    return b"\n".join(parts)


def fit(rows: list, sizes: dict | None = None, dict_bytes: int = DICT_BYTES) -> Model:
    """Model from sample rows (label, builds the dictionary, text).

    ``sizes`` are the rows of each label in the whole training set: the
    calibration weighs the sample's classes by them.
    """
    build = {label: [t.encode() for q, d, t in rows if q == label and d] for label in (0, 1)}
    tune = [(q, t.encode()) for q, d, t in rows if not d]
    if not build[0] or not build[1] or len({q for q, _ in tune}) < 2:
        n = len(rows)
        return Model(None, None, None, None, sum(q for q, _, _ in rows) / n if n else 0.5)
    model = Model([_dictionary(build[1], dict_bytes), _dictionary(build[0], dict_bytes)], None, None, None, 0.5)
    plain, good, bad = model.compressors()
    x = np.array([_features(t, plain, good, bad) for _, t in tune])
    y = np.array([q for q, _ in tune], dtype=float)
    model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    share = {q: (y == q).mean() for q in (0, 1)}
    sizes = sizes or share
    total = sum(sizes.values())
    weight = np.where(y == 1, sizes.get(1, 0) / total / share[1], sizes.get(0, 0) / total / share[0])
    model.weights = _logistic(_expand((x - model.mean) / model.scale), y, weight)
    return model


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row, from its whole text."""
    def run(batches):
        plain = good = bad = None
        if model.weights is not None:
            plain, good, bad = model.compressors()
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary()).to_pylist()
            if plain is None:
                made = np.full(len(texts), model.prior)
            else:
                made = model.scores(np.array([_features(t or b"", plain, good, bad) for t in texts]).reshape(-1, N_FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.float64())], names=["row", "score"])

    d = docs.select(F.col(key).cast("long").alias("row"), F.col(text).alias("text"))
    return d.mapInArrow(run, "row long, score double").withColumnRenamed("row", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = fit(*sample(docs, labels, "doc_id", "text", PER_CLASS, SAMPLE_CHARS))
    out = score(docs, model).withColumn("held_out", held_out(F.col("doc_id")))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
