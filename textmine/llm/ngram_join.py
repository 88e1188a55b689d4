"""N-gram Jaccard join: MinHash bands find candidates, full n-gram sets decide.

Two documents are linked when the Jaccard similarity of their sets of
``size``-word shingles is ``threshold`` or more.  ``choose_bands`` picks the
number of bands and rows for a target recall at exactly the threshold.

1. ``sketch`` gives each row a digest of its words and one hash for each band.
   Copies (equal words) are one *text*, represented by their smallest id and
   weighted by their number; only texts go on.
2. Texts are shuffled on their band hashes.  A bucket of at most ``bucket``
   texts gives its pairs.  Larger buckets give no pairs: the buckets that share
   texts form a *cluster*, whose texts are dealt into blocks of ``block`` and
   compared block against block, each pair of blocks in a task of its own; a
   block task returns a sum for each of its texts, never a row for each pair.
3. Pairs are verified on the full shingle sets; links add up to each
   document's ``n_links`` and connected components give its ``class_id``.

Defined cases: a null or empty text has no shingles, no links and is its own
class; a text of fewer words than a shingle has one shingle, all its words; a
row without id has a null class and no links; rows that repeat an id are one
document (with different texts, that of the smallest digest); a similarity of
exactly the threshold is a link; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmine.llm.common import read_table, staged, words
from textmine.llm.components import connected_components
from textmine.llm.wordhash import WINDOW_BASE, mix, text_slices, window_hashes, word_hashes

SIZE = 5
THRESHOLD = 0.8
RECALL = 0.9999
MAX_HASHES = 192
BUCKET = 32
BLOCK = 256


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows, so the fewest false candidates, with the recall at the threshold.

    A pair of similarity s shares a band with probability 1 - (1 - s**rows)**bands.
    """
    best = (max_hashes, 1)
    for rows in range(1, max_hashes + 1):
        bands = math.ceil(math.log1p(-recall) / math.log1p(-threshold**rows))
        if bands * rows <= max_hashes:
            best = (bands, rows)
    return best


def hash_family(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of ``n`` multiply-add hashes (a fixed seed: sketches must agree)."""
    rng = np.random.default_rng(5)
    return (rng.integers(1, 1 << 63, size=n, dtype=np.uint64) * np.uint64(2) + np.uint64(1),
            rng.integers(0, 1 << 63, size=n, dtype=np.uint64))


def shingles(words: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Hashes of all shingles of one text, in order."""
    return window_hashes(words, min(size, len(words))) if len(words) else words


def _band_hashes(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """One row of ``bands`` hashes for each non-empty shingle array."""
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    mul, add = hash_family(bands * rows)
    out = np.empty((len(sets), bands), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for b in range(bands):
            acc = np.full(len(sets), b, dtype=np.uint64)
            for i in range(b * rows, (b + 1) * rows):
                acc = acc * np.uint64(WINDOW_BASE) + np.minimum.reduceat(flat * mul[i] + add[i], starts)
            out[:, b] = mix(acc)
    return out


def sketch(df: DataFrame, key: str, text: str, size: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, digest, bands) of every row; no bands for a text without words."""
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for a, b, data, offsets in text_slices(batch.column(1)):
                words, bounds, _, _ = word_hashes(data, offsets)
                raw = data.tobytes()
                digests = [hashlib.sha256(b" ".join(raw[offsets[r]:offsets[r + 1]].split())).hexdigest() for r in range(b - a)]
                full = np.flatnonzero(np.diff(bounds))
                hashes = np.zeros((0, bands), dtype=np.uint64)
                if len(full):
                    hashes = _band_hashes([shingles(words[bounds[r]:bounds[r + 1]], size) for r in full], bands, rows)
                lengths = np.zeros(b - a + 1, dtype=np.int32)
                lengths[full + 1] = bands
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum(lengths, dtype=np.int32)), pa.array(hashes.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a).cast(pa.int64()), pa.array(digests, pa.string()), lists],
                                                 names=["doc_id", "digest", "bands"])

    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, digest string, bands array<long>")


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """(id, set) of the texts asked for; ``docs`` is (id, digest, text)."""
    def run(batches):
        for batch in batches:
            cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for a, b, data, offsets in text_slices(cols["text"]):
                words, bounds, _, _ = word_hashes(data, offsets)
                raw = data.tobytes()
                digests = cols["digest"].slice(a, b - a).to_pylist()
                rows, sets = [], []
                for r in range(b - a):
                    if hashlib.sha256(b" ".join(raw[offsets[r]:offsets[r + 1]].split())).hexdigest() == digests[r]:
                        rows.append(a + r)
                        sets.append(np.unique(shingles(words[bounds[r]:bounds[r + 1]], size)).view(np.int64))
                if rows:
                    lengths = np.cumsum([0, *map(len, sets)], dtype=np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [cols["id"].take(pa.array(rows)), pa.ListArray.from_arrays(pa.array(lengths), pa.array(np.concatenate(sets)))],
                        names=["id", "set"])

    return docs.select("id", "digest", "text").mapInArrow(run, "id long, set array<long>")


def _intersections(left: list[np.ndarray], right: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of all intersections, as products of 0/1 matrices over slices of the shared shingles."""
    both = [*left, *right]
    values, column, count = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1
    row = np.repeat(np.arange(len(both)), [len(s) for s in both])
    keep = count[column] > 1
    row, column = row[keep], shared[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    for at in range(0, int((count > 1).sum()), width):
        lo, hi = np.searchsorted(column, [at, at + width])
        dense = np.zeros((len(both), width), dtype=np.float32)
        dense[row[lo:hi], column[lo:hi] - at] = 1
        out += dense[:len(left)] @ dense[len(left):].T
    return out


def _block_links(threshold: float):
    """Function of one pair of blocks: (id, links, root) of its texts with links inside the pair."""
    def run(key, table):
        i, j = key[1].as_py(), key[2].as_py()
        part = table.column("part").to_numpy()
        ids, weight = table.column("id").to_numpy(), table.column("weight").to_numpy()
        sets = [np.asarray(s, dtype=np.int64) for s in table.column("set").combine_chunks().to_numpy(zero_copy_only=False)]
        left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
        ends = pa.table({"id": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        if not len(left) or not len(right):
            return ends
        inter = _intersections([sets[x] for x in left], [sets[x] for x in right]).astype(np.float64)
        n = np.array([len(s) for s in sets], dtype=np.float64)
        linked = inter / (n[left][:, None] + n[right][None, :] - inter) >= threshold
        if i == j:
            np.fill_diagonal(linked, False)
        links = np.zeros(len(ids), dtype=np.int64)
        links[left] += linked @ weight[right]
        if i != j:
            links[right] += linked.T @ weight[left]
        root = ids.copy()
        while True:  # smallest id of each component inside the pair of blocks
            low = root.copy()
            reach = np.where(linked, root[right][None, :], np.iinfo(np.int64).max).min(axis=1)
            low[left] = np.minimum(low[left], reach)
            reach = np.where(linked, low[left][:, None], np.iinfo(np.int64).max).min(axis=0)
            low[right] = np.minimum(low[right], reach)
            if (low == root).all():
                break
            root = low
        hit = links > 0
        return pa.table({"id": pa.array(ids[hit]), "links": pa.array(links[hit]), "root": pa.array(root[hit])})

    return run


def join(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, threshold: float = THRESHOLD,
         recall: float = RECALL, max_hashes: int = MAX_HASHES, bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """(key, class_id, n_links) of every row.

    ``n_links`` counts the other documents, copies included, with a similarity
    of ``threshold`` or more; ``class_id`` is the smallest id that links lead to.
    """
    bands, rows = choose_bands(threshold, recall, max_hashes)
    sk = staged(sketch(df, key, text, size, bands, rows), "jaccard-sketch")
    # One text for each id, one representative for each text.
    texts = sk.filter("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("digest", "bands")).alias("x"))
    texts = staged(texts.select("doc_id", "x.digest", "x.bands"), "jaccard-texts")
    reps = texts.filter(F.size("bands") > 0).groupBy("digest").agg(
        F.min("doc_id").alias("id"), F.count("*").alias("weight"), F.first("bands").alias("bands"))
    reps = staged(reps, "jaccard-reps")
    entries = reps.select("id", F.explode("bands").alias("band"))
    full = entries.groupBy("band").agg(F.count("*").alias("n"), F.min("id").alias("low")).filter("n > 1")
    entries = staged(entries.join(full, "band"), "jaccard-buckets")

    # Small buckets: every pair once.
    small = entries.filter(F.col("n") <= bucket).groupBy("band").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    small = small.select(F.posexplode("ids").alias("i", "x"), "ids")
    pairs = small.select("x", F.explode(F.slice("ids", F.col("i") + 2, bucket)).alias("y")).distinct()
    # Large ones: the texts of buckets that hang together.
    hot = connected_components(entries.filter(F.col("n") > bucket).select(F.col("low").alias("u"), F.col("id").alias("v")))
    hot = hot.select(F.col("node").alias("id"), F.col("root").alias("cluster"))
    inside = pairs.join(hot.select(F.col("id").alias("x"), F.col("cluster").alias("cx")), "x", "left").join(
        hot.select(F.col("id").alias("y"), F.col("cluster").alias("cy")), "y", "left")
    pairs = staged(inside.filter(~F.coalesce(F.col("cx") == F.col("cy"), F.lit(False))).select("x", "y"), "jaccard-pairs")

    need = pairs.select(F.col("x").alias("id")).unionByName(pairs.select(F.col("y").alias("id"))).unionByName(
        hot.select("id")).distinct().join(reps.select("id", "digest", "weight"), "id")
    docs = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    sets = _sets(docs.join(need.select("id", "digest"), "id"), size).dropDuplicates(["id"])
    sets = staged(sets.join(need.select("id", "weight"), "id"), "jaccard-sets")

    # Verify pairs: a set travels once for each of its pairs as ``y``.
    right = pairs.join(sets.select(F.col("id").alias("y"), F.col("set").alias("ys"), F.col("weight").alias("yw")), "y")
    both = right.join(sets.select(F.col("id").alias("x"), F.col("set").alias("xs"), F.col("weight").alias("xw")), "x")
    both = both.withColumn("n", F.size(F.array_intersect("xs", "ys")))
    similar = F.col("n") / (F.size("xs") + F.size("ys") - F.col("n")) >= threshold
    links = staged(both.filter(similar).select("x", "y", "xw", "yw"), "jaccard-links")

    # Verify clusters block by block.
    members = sets.join(hot, "id")
    sizes = hot.groupBy("cluster").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("parts"))
    members = members.join(sizes, "cluster").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    members = members.select("cluster", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"),
                             "part", "id", "weight", "set")
    blocks = staged(members.groupBy("cluster", "i", "j").applyInArrow(_block_links(threshold), "id long, links long, root long"),
                    "jaccard-blocks")

    edges = links.select(F.col("x").alias("u"), F.col("y").alias("v")).unionByName(
        blocks.select(F.col("root").alias("u"), F.col("id").alias("v")))
    classes = connected_components(edges).select(F.col("node").alias("id"), F.col("root").alias("class_id"))
    counts = links.select(F.col("x").alias("id"), F.col("yw").alias("links")).unionByName(
        links.select(F.col("y").alias("id"), F.col("xw").alias("links"))).unionByName(blocks.select("id", "links"))
    counts = counts.groupBy("id").agg(F.sum("links").alias("links"))
    by_text = reps.join(classes, "id", "left").join(counts, "id", "left").select(
        "digest", F.coalesce("class_id", "id").alias("class_id"),
        (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"))
    by_doc = texts.select("doc_id", "digest").join(by_text, "digest", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    out = sk.select("doc_id").join(by_doc, "doc_id", "left")
    return out.select(F.col("doc_id").alias(key), "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", **params) -> DataFrame:
    """The rows of ``df``, all columns, that represent their class: one for each class.

    Rows without id all stay.  Of several rows with one id the one stays whose
    words have the smallest digest, by which ``join`` has put the id in its class.
    """
    classes = join(df, key, text, **params)
    keep = staged(classes.filter(F.col(key) == F.col("class_id")).select(key).distinct(), "jaccard-keep")
    digest = F.sha2(F.array_join(words(F.col(text)), " ").cast("binary"), 256)
    kept = df.join(keep, key, "left_semi").groupBy(F.col(key).alias("k")).agg(
        F.min_by(F.struct(*df.columns), F.struct(digest, F.col(text))).alias("row")).select("row.*")
    return kept.unionByName(df.filter(F.col(key).isNull()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(read_table(spark, sf_dir, "documents"))


SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
      FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + {SIZE - 1}], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SIZE - 1}, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT x, y FROM p JOIN n nx ON x = nx.doc_id JOIN n ny ON y = ny.doc_id
      WHERE c::DOUBLE / (nx.n + ny.n - c) >= {THRESHOLD}::DOUBLE),
r(x, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.x AND r.root < l.y)
SELECT d.doc_id, (SELECT min(root) FROM r WHERE r.x = d.doc_id) AS class_id,
       (SELECT count(*) FROM l WHERE l.x = d.doc_id)::BIGINT AS n_links
FROM d
"""
