"""Periodic run detection in word sequences by longest common extensions.

A run is a stretch of words with smallest period q (words q apart are equal)
that no neighbouring word extends; ``exponent`` periods and ``min_length`` words
are asked for.  Per document:

1. A run of that length holds each of its ``GRAM``-word windows several times.
   Words that no window with so many occurrences in the document covers lie in
   no run; each gap of them becomes one symbol that occurs nowhere else, which
   no run can cross.  This loses nothing: windows are counted by hashes, and a
   collision can only keep more words.
2. Ukkonen's suffix trees of the remaining sequence and of its reversal answer
   longest common extensions by lowest common ancestors in constant time.
3. The longest Lyndon words at all places, for both symbol orders, are extended
   in both directions; those that reach are the runs (``suffix_tree``).

Work inside a document is linear but for the tables of least depths (n log n).
Documents are rows: Spark deals them out, nothing is shuffled, and a task holds
one slice of texts and the trees of one document at a time.

Defined cases: a null or empty text has 0 words and no runs, and its collapsed
text is empty; null and repeated keys are passed on, row by row; of runs with the
same start the shorter period comes first; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmine.llm.common import read_table, words
from textmine.llm.ragged import offsets_of
from textmine.llm.suffix_tree import runs
from textmine.llm.wordhash import mix, text_slices, window_hashes, word_hashes

EXPONENT = 4
MIN_LENGTH = 6
GRAM = 3
RUN = "struct<start:long,length:long,period:long>"


def _occurrences(exponent: int, min_length: int) -> int:
    """How often a run holds each of its windows, at least: over period 1, and over longer periods."""
    return min(max(min_length, exponent) - GRAM + 1, exponent - 1)


def _candidates(hashes: np.ndarray, bounds: np.ndarray, least: int) -> np.ndarray:
    """Marks the words that a window with ``least`` or more occurrences in its document covers."""
    n = len(hashes)
    if least < 2:
        return np.ones(n, dtype=bool)
    marked = np.zeros(n, dtype=bool)
    grams = window_hashes(hashes, GRAM)
    if not len(grams):
        return marked
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = np.flatnonzero(row[:len(grams)] == row[GRAM - 1:])
    _, code, count = np.unique(mix(grams[at] ^ mix(row[at].astype(np.uint64))), return_inverse=True, return_counts=True)
    at = at[count[code] >= least]
    for k in range(GRAM):
        marked[at + k] = True
    return marked


def document_runs(texts: list[bytes], marked: np.ndarray, exponent: int, min_length: int) -> np.ndarray:
    """Runs (start, length, period) of a document of ``texts`` words, of which ``marked`` may lie in one."""
    place = np.flatnonzero(marked)
    if len(place) < min_length:
        return np.zeros((0, 3), dtype=np.int64)
    codes: dict[bytes, int] = {}
    symbols, where, before = [], [], None
    for i in place.tolist():
        if before is not None and i != before + 1:
            codes[b"", i] = len(codes)  # a gap: a symbol of its own
            symbols.append(len(codes) - 1)
            where.append(-1)
        symbols.append(codes.setdefault(texts[i], len(codes)))
        where.append(i)
        before = i
    found = runs(symbols)
    found = found[found[:, 1] >= np.maximum(min_length, exponent * found[:, 2])]
    found[:, 0] = np.array(where)[found[:, 0]]
    return found


def _dropped(found: np.ndarray, n: int) -> np.ndarray:
    """Marks the words behind the first period of a run."""
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, found[:, 0] + found[:, 2], 1)
    np.add.at(step, found[:, 0] + found[:, 1], -1)
    return np.cumsum(step[:n]) > 0


def find_runs(df: DataFrame, key: str = "doc_id", text: str = "text", exponent: int = EXPONENT,
              min_length: int = MIN_LENGTH) -> DataFrame:
    """(key, n_words, runs, collapsed) of every row.

    ``runs`` are (start, length, period) by start, then period, in words from 0;
    ``collapsed`` is the text's words without those that repeat a run's first
    period, joined by one space.
    """
    if exponent < 2:
        raise ValueError("a run holds its period twice at least")
    least = _occurrences(exponent, min_length)

    def run(batches):
        kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        for batch in batches:
            keys, column = batch.column(0), batch.column(1)
            for a, b, data, offsets in text_slices(column):
                hashes, bounds, _, _ = word_hashes(data, offsets)
                marked = _candidates(hashes, bounds, least)
                counts, found, kept = np.diff(bounds), [], []
                raw = data.tobytes()
                for r, n in enumerate(counts.tolist()):
                    texts = raw[offsets[r]:offsets[r + 1]].split()
                    mine = document_runs(texts, marked[bounds[r]:bounds[r + 1]], exponent, min_length)
                    if len(mine):
                        texts = itertools.compress(texts, ~_dropped(mine, n))
                    found.append(mine)
                    kept.append(b" ".join(texts))
                flat = np.concatenate([*found, np.zeros((0, 3), dtype=np.int64)])
                lists = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(kind))
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(a, b - a), pa.array(counts, pa.int64()),
                     pa.ListArray.from_arrays(pa.array(offsets_of([len(f) for f in found]).astype(np.int32)), lists),
                     pa.array(kept, pa.binary()).cast(pa.string())],
                    names=["row", "n_words", "runs", "collapsed"])

    out = df.select(F.col(key).cast("long").alias("row"), F.col(text).alias("text")).mapInArrow(
        run, f"row long, n_words long, runs array<{RUN}>, collapsed string")
    return out.withColumnRenamed("row", key)


def planted(key: Column, text: Column) -> Column:
    """The text, or for a tenth of the keys (by crc32) one whose words repeat with a period from some word on."""
    h = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def repeat(ws):
        n = F.size(ws).cast("long")
        a = (g % n).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
        period = F.slice(ws, a + 1, p)
        tail = F.slice(F.flatten(F.array_repeat(period, F.ceil((n - a) / p).cast("int"))), F.lit(1), (n - a).cast("int"))
        return F.array_join(F.concat(F.slice(ws, F.lit(1), a), tail), " ")

    ws = words(text)
    return F.when((h % 10 == 0) & (F.size(ws) > 0), repeat(ws)).otherwise(text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document of the planted texts: their number, the longest, and digests of runs and collapsed text."""
    docs = read_table(spark, sf_dir, "documents")
    made = find_runs(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text")))
    ranked = F.array_sort(F.transform("runs", lambda r: F.struct((-r.length).alias("less"), r.start.alias("start"), r.period.alias("period"))))
    best = F.get(ranked, F.lit(0))
    length = -best.less
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    return made.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best.start.alias("start"), length.alias("length"),
        best.period.alias("period"), F.floor(1000 * length / best.period).cast("long").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
