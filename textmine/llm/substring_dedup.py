"""Substring dedup: words covered by a window that an earlier document holds too.

A window is ``window`` consecutive words; a word goes when some window over it
also starts in a document with a smaller id.  The method streams documents
through suffix automata of reference shards and keeps the maximal spans whose
matching statistic reaches the window length.  So that this holds at any size,
references are not whole documents but only their passages that repeat:

1. ``sketch``: each document's words are hashed; exact copies are recognised by
   digest, and every window is represented by its minimiser, the smallest hash
   of the ``gram``-word runs in it (equal windows have equal minimisers).
2. Minimisers that occur in one document only are dropped; for the windows of
   the others, a hash of the whole window finds the windows of two or more
   documents and the smallest document of each.  Both steps can only let too
   much through (equal hashes), never lose a window.
3. Those windows form *reference passages* (in the smallest document) and
   *streams* (in the others).  Passages are dealt into shards by document;
   each shard's automaton is built where its streams are, and a shard with many
   streams is sent to several tasks, each taking a part of the streams.
4. The automaton works on the words themselves and knows the smallest document
   of each state, so its spans are exact.

Every step groups by hashes with map-side aggregation or by one document; a
passage that a third of the documents share is one reference and its streams
are spread.

Defined cases: a null text has no words; a row without id is neither changed
nor a reference; rows that repeat an id do not remove each other's words; ties
(several earlier documents) do not matter, any smaller id suffices; a text of
fewer words than the window is never changed; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmine.llm.common import read_table, staged
from textmine.llm.suffix_automaton import SuffixAutomaton
from textmine.llm.wordhash import sliding_min_positions, text_slices, window_hashes, word_hashes

WINDOW = 50
GRAM = 16
SHARD_WORDS = 50_000     # reference words in a shard, about
STREAM_WORDS = 400_000   # streamed words of a shard in one task, about

EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _lists(parts: list[np.ndarray], kind) -> pa.Array:
    """ListArray from one numpy array per row."""
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(kind)))


def _minimisers(words: np.ndarray, window: int, gram: int) -> np.ndarray:
    """Minimiser of every window."""
    grams = window_hashes(words, gram)
    return grams[sliding_min_positions(grams, window - gram + 1)]


def sketch(df: DataFrame, key: str, text: str, window: int, gram: int) -> DataFrame:
    """(doc_id, digest, n_words, minimisers) of every row."""
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for a, b, data, offsets in text_slices(batch.column(1)):
                words, bounds, _, _ = word_hashes(data, offsets)
                raw = data.tobytes()
                digests, minis = [], []
                for r in range(b - a):
                    own = raw[offsets[r]:offsets[r + 1]].split()
                    digests.append(hashlib.sha256(b" ".join(own)).hexdigest())
                    minis.append(np.unique(_minimisers(words[bounds[r]:bounds[r + 1]], window, gram)).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a).cast(pa.int64()), pa.array(digests, pa.string()),
                     pa.array(np.diff(bounds).astype(np.int64)), _lists(minis, np.int64)],
                    names=["doc_id", "digest", "n_words", "minimisers"])

    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, digest string, n_words long, minimisers array<long>")


def _candidates(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(doc_id, digest, words, pos, hash): windows whose minimiser is shared, per document.

    ``docs`` is (doc_id, digest, text, shared); a row whose text is not the one
    of the digest (an id with several texts) is left out.
    """
    def run(batches):
        for batch in batches:
            names = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for a, b, data, offsets in text_slices(names["text"]):
                words, bounds, _, _ = word_hashes(data, offsets)
                raw = data.tobytes()
                digests = names["digest"].slice(a, b - a).to_pylist()
                rows, texts, pos, hashes = [], [], [], []
                for r in range(b - a):
                    flat = b" ".join(raw[offsets[r]:offsets[r + 1]].split())
                    if hashlib.sha256(flat).hexdigest() != digests[r]:
                        continue
                    own = words[bounds[r]:bounds[r + 1]]
                    shared = names["shared"][a + r].values.to_numpy(zero_copy_only=False).view(np.uint64)
                    at = np.flatnonzero(np.isin(_minimisers(own, window, gram), shared))
                    rows.append(a + r)
                    texts.append(flat.decode("utf-8"))
                    pos.append(at)
                    hashes.append(window_hashes(own, window)[at].view(np.int64))
                if rows:
                    take = pa.array(rows)
                    yield pa.RecordBatch.from_arrays(
                        [names["doc_id"].take(take), names["digest"].take(take), pa.array(texts, pa.string()),
                         _lists(pos, np.int32), _lists(hashes, np.int64)],
                        names=["doc_id", "digest", "words", "pos", "hash"])

    return docs.select("doc_id", "digest", "text", "shared").mapInArrow(
        run, "doc_id long, digest string, words string, pos array<int>, hash array<long>")


def _passages(marked: DataFrame, window: int) -> DataFrame:
    """Runs of windows with one smallest document, as word spans of the text.

    ``marked`` is (doc_id, digest, words, marks) with marks (pos, first) in
    order.  ``first`` = ``doc_id`` makes a reference passage, else a stream.
    """
    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            out = {n: [] for n in ("first", "doc_id", "digest", "start", "n", "passage")}
            for row in rows:
                words = row["words"].split(" ")
                marks = row["marks"]
                i = 0
                while i < len(marks):
                    j = i
                    while (j + 1 < len(marks) and marks[j + 1]["first"] == marks[i]["first"]
                           and marks[j + 1]["pos"] == marks[j]["pos"] + 1):
                        j += 1
                    a, b = marks[i]["pos"], marks[j]["pos"] + window
                    out["first"].append(marks[i]["first"])
                    out["doc_id"].append(row["doc_id"])
                    out["digest"].append(row["digest"])
                    out["start"].append(a)
                    out["n"].append(b - a)
                    out["passage"].append(" ".join(words[a:b]))
                    i = j + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["first"], pa.int64()), pa.array(out["doc_id"], pa.int64()), pa.array(out["digest"], pa.string()),
                 pa.array(out["start"], pa.int32()), pa.array(out["n"], pa.int32()), pa.array(out["passage"], pa.string())],
                names=list(out))

    return marked.select("doc_id", "digest", "words", "marks").mapInArrow(
        run, "first long, doc_id long, digest string, start int, n int, passage string")


def _stream_through(passages: DataFrame, window: int, shard_words: int, stream_words: int) -> DataFrame:
    """(doc_id, digest, start, end): spans of the streams that the shards' automata confirm."""
    total = passages.filter("first = doc_id").agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-int(total) // shard_words))
    p = passages.withColumn("shard", F.pmod(F.xxhash64("first"), F.lit(shards)))
    load = p.filter("first <> doc_id").groupBy("shard").agg(
        F.ceil(F.sum("n") / F.lit(stream_words)).cast("int").alias("parts"))
    p = p.join(load, "shard")  # shards without streams drop out
    reference = F.col("first") == F.col("doc_id")
    part = F.when(reference, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(
        F.array(F.pmod(F.xxhash64("doc_id", "digest"), F.col("parts")).cast("int")))
    p = p.withColumn("part", F.explode(part))

    def match(key, table):
        automaton, streams = SuffixAutomaton(), []
        for first, doc, digest, start, passage in zip(
                *(table.column(n).to_pylist() for n in ("first", "doc_id", "digest", "start", "passage")), strict=True):
            if first == doc:
                automaton.add(passage.split(" "), doc)
            else:
                streams.append((doc, digest, start, passage))
        automaton.finish()
        found = [(doc, digest, start + a, start + b) for doc, digest, start, passage in streams
                 for a, b in automaton.spans(passage.split(" "), doc, window)]
        cols = list(zip(*found, strict=True)) or [(), (), (), ()]
        return pa.table({"doc_id": pa.array(cols[0], pa.int64()), "digest": pa.array(cols[1], pa.string()),
                         "start": pa.array(cols[2], pa.int32()), "end": pa.array(cols[3], pa.int32())})

    return p.groupBy("shard", "part").applyInArrow(match, "doc_id long, digest string, start int, end int")


def repeated_spans(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM,
                   shard_words: int = SHARD_WORDS, stream_words: int = STREAM_WORDS):
    """(sketch, firsts, spans): what to remove.

    ``sketch`` is (doc_id, digest, n_words, minimisers) of every row, ``firsts``
    (digest, first) the smallest id of each text, and ``spans`` (doc_id, digest,
    words, spans) the word spans to remove from the first copy of a text;
    later copies of a text of at least ``window`` words go as a whole.
    """
    if gram >= window:
        raise ValueError("gram must be smaller than window")
    sk = staged(sketch(df, key, text, window, gram), "substring-sketch")
    known = sk.filter("doc_id is not null")
    firsts = known.groupBy("digest").agg(F.min("doc_id").alias("first"))
    # Copies carry equal minimisers: one row for each text, map-side first.
    reps = known.filter(F.size("minimisers") > 0).groupBy("digest").agg(
        F.min("doc_id").alias("doc_id"), F.first("minimisers").alias("minimisers"))
    reps = staged(reps, "substring-texts")
    grams = reps.select("doc_id", "digest", F.explode("minimisers").alias("m"))
    shared = grams.groupBy("m").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("m")
    lists = grams.join(shared, "m").groupBy("doc_id", "digest").agg(F.collect_list("m").alias("shared"))
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    cand = staged(_candidates(docs.join(lists, "doc_id"), window, gram), "substring-windows")
    wins = cand.select("doc_id", "digest", F.explode(F.arrays_zip("pos", "hash")).alias("x")).select(
        "doc_id", "digest", "x.pos", "x.hash")
    firstdoc = wins.groupBy("hash").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("hi")).filter(
        "first < hi").select("hash", "first")
    # Read from a table, both sides of the join are plain exchanges, which the
    # engine can split where one hash (a very common passage) fills a partition.
    firstdoc = staged(firstdoc, "substring-repeats")
    marks = wins.join(firstdoc, "hash").groupBy("doc_id", "digest").agg(
        F.sort_array(F.collect_set(F.struct("pos", "first"))).alias("marks"))
    marked = cand.select("doc_id", "digest", "words").join(marks, ["doc_id", "digest"])
    passages = staged(_passages(marked, window), "substring-passages")
    spans = _stream_through(passages, window, shard_words, stream_words)
    spans = spans.groupBy("doc_id", "digest").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))
    texts = cand.select("doc_id", "digest", "words").dropDuplicates(["doc_id", "digest"])
    return sk, firsts, texts.join(spans, ["doc_id", "digest"])


def _cut(spans: DataFrame) -> DataFrame:
    """(doc_id, digest, n_removed, kept): the words that stay, joined by one space."""
    def run(batches):
        for batch in batches:
            out = {"doc_id": [], "digest": [], "n_removed": [], "kept": []}
            for row in batch.to_pylist():
                words = row["words"].split(" ")
                gone = np.zeros(len(words) + 1, dtype=np.int64)
                for s in row["spans"]:
                    gone[s["start"]] += 1
                    gone[s["end"]] -= 1
                gone = np.cumsum(gone)[:-1] > 0
                out["doc_id"].append(row["doc_id"])
                out["digest"].append(row["digest"])
                out["n_removed"].append(int(gone.sum()))
                out["kept"].append(" ".join(w for w, g in zip(words, gone, strict=True) if not g))
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["doc_id"], pa.int64()), pa.array(out["digest"], pa.string()),
                 pa.array(out["n_removed"], pa.int64()), pa.array(out["kept"], pa.string())], names=list(out))

    return spans.select("doc_id", "digest", "words", "spans").mapInArrow(
        run, "doc_id long, digest string, n_removed long, kept string")


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM,
          shard_words: int = SHARD_WORDS, stream_words: int = STREAM_WORDS) -> DataFrame:
    """(key, n_words, n_removed, kept, kept_sha256) of every row.

    ``kept`` is the kept words joined by one space, null where no word was
    removed (the text's own words stand); ``kept_sha256`` is always its digest.
    """
    sk, firsts, spans = repeated_spans(df, key, text, window, gram, shard_words, stream_words)
    cut = _cut(spans).withColumn("cut_sha", F.sha2("kept", 256))
    d = sk.select("doc_id", "digest", "n_words").join(firsts, "digest", "left").join(cut, ["doc_id", "digest"], "left")
    copy = (F.col("first") < F.col("doc_id")) & (F.col("n_words") >= window)
    return d.select(
        F.col("doc_id").alias(key), "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit("")).otherwise(F.col("kept")).alias("kept"),
        F.when(copy, F.lit(EMPTY_SHA)).otherwise(F.coalesce("cut_sha", "digest")).alias("kept_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(read_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
        list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT rid, doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW}),
k AS (SELECT rid, doc_id, i, sha256(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS win FROM i),
f AS (SELECT win, min(doc_id) AS first FROM k GROUP BY win),
g AS (SELECT DISTINCT rid, unnest(range(i, i + {WINDOW})) AS p FROM k JOIN f ON k.win = f.win WHERE f.first < k.doc_id),
e AS (SELECT d.rid, doc_id, len(w) AS n_words, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d WHERE len(w) > 0),
t AS (SELECT e.rid, string_agg(word, ' ' ORDER BY e.p) AS kept, count(*) AS n
      FROM e LEFT JOIN g ON e.rid = g.rid AND e.p = g.p WHERE g.p IS NULL GROUP BY e.rid)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(t.n, 0))::BIGINT AS n_removed,
       sha256(coalesce(t.kept, '')) AS kept_sha256
FROM d LEFT JOIN t ON d.rid = t.rid
"""
