"""SentencePiece encoding and decoding as a parallel max-plus scan.

Documents of at most ``chunk`` characters are encoded where they are.  A longer
one is split into chunks at fixed places, whatever stands there, and:

1. each chunk, on any executor, gives its transfer: the weight of the best path
   from every piece that may cover the last character before the chunk to every
   piece that may cover its own last character (a max-plus matrix, held as its
   finite entries);
2. the transfers of a document are combined associatively, forwards and
   backwards, which fixes the piece at each border of the best path;
3. each chunk, knowing its border pieces, is traced back on its own.

Paths and weights are those of ``piece_lattice``; for a bpe model they give the
library's ids.  Equal long texts are encoded once.  The vocabulary is read on
the driver from ``model_file`` and broadcast (some megabytes at most, checked).

Defined cases: a null text has null ids and 0 tokens, an empty text has no ids;
null and repeated keys are passed on, row by row; the best path of a bpe model
is unique, ties of a unigram model go to the first found; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmine.llm.common import read_table, staged
from textmine.llm.piece_lattice import Decoder, Lattice, load_vocabulary, normalise

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 32_768
MAX_PIECES = 1_000_000  # vocabulary entries that may be broadcast
EMIT = 1 << 20          # ids in an outgoing batch, about

_STATE = "struct<start:long,end:long>"
_TRANSFERS = f"digest string, k int, entries array<struct<enter:{_STATE},leave:{_STATE},weight:double>>"


def _held(broadcast, name: str, make):
    """An object kept beside a broadcast value, so tasks of one worker share it and its memory of segments."""
    value = broadcast.value
    if name not in value:
        value[name] = make(value)
    return value[name]


def broadcast_vocabulary(spark: SparkSession, model_file: str = MODEL_FILE):
    vocabulary = load_vocabulary(model_file)
    if len(vocabulary["pieces"]) > MAX_PIECES:
        raise ValueError("vocabulary is too large to broadcast")
    return spark.sparkContext.broadcast(vocabulary)


def _id_lists(parts: list[bytes]) -> pa.Array:
    lengths = np.cumsum([0, *(len(p) // 4 for p in parts)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(lengths), pa.array(np.frombuffer(b"".join(parts), dtype=np.int32)))


def _encode_whole(docs: DataFrame, vocabulary, kind: str) -> DataFrame:
    """(row, ids) for ``docs`` (row, text)."""
    def run(batches):
        lattice = _held(vocabulary, f"lattice-{kind}", lambda v: Lattice(v, kind))
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            parts, first, held = [], 0, 0
            for r, text in enumerate(texts):
                parts.append(lattice.encode(text.as_py()))
                held += len(parts[-1]) // 4
                if held >= EMIT or r == len(texts) - 1:
                    yield pa.RecordBatch.from_arrays([keys.slice(first, len(parts)), _id_lists(parts)], names=["row", "ids"])
                    parts, first, held = [], r + 1, 0

    return docs.mapInArrow(run, "row long, ids array<int>")


def _chunks(texts: DataFrame, context: int, chunk: int) -> DataFrame:
    """(digest, k, total, start, offset, piece): chunks of the normalised text with their surroundings.

    Chunk k is [start, start + chunk) of ``total`` characters; ``piece`` starts
    at ``offset`` and reaches ``context`` characters beyond the chunk's end.
    """
    def run(batches):
        for batch in batches:
            for digest, text in zip(batch.column(0), batch.column(1), strict=True):
                whole = normalise(text.as_py())
                for k, start in enumerate(range(0, len(whole), chunk)):
                    offset = max(0, start - context)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([digest.as_py()]), pa.array([k], pa.int32()), pa.array([len(whole)], pa.int64()),
                         pa.array([start], pa.int64()), pa.array([offset], pa.int64()),
                         pa.array([whole[offset:start + chunk + context]])],
                        names=["digest", "k", "total", "start", "offset", "piece"])

    return texts.mapInArrow(run, "digest string, k int, total long, start long, offset long, piece string")


def _covering(lattice: Lattice, text: str, place: int) -> list:
    """Pieces (start, end) that may cover character ``place - 1``; None where a cut makes it certain."""
    if lattice.is_cut(text, place):
        return [None]
    found = []
    for a in range(max(0, place - lattice.longest), place):
        for b in range(place, min(len(text), a + lattice.longest) + 1):
            if lattice.is_piece(text[a:b]) and lattice.step(None, text[a:b]) is not None:
                found.append((a, b))
    return found


def _entries(lattice: Lattice, text: str, a: int) -> list:
    return [(s, a if s is None else s[1]) for s in _covering(lattice, text, a)]


def _first_cut(lattice: Lattice, text: str, a: int, b: int) -> int | None:
    return next((i for i in range(a, b + 1) if lattice.is_cut(text, i)), None)


def _last_cut(lattice: Lattice, text: str, a: int, b: int) -> int:
    return next(i for i in range(b, a - 1, -1) if lattice.is_cut(text, i))


def transfer(lattice: Lattice, text: str, a: int, b: int) -> dict:
    """Finite entries {(enter, leave): weight} of the max-plus matrix of text[a:b].

    A state is the piece over the character before the border, (start, end), or
    None where no piece can cross the border.
    """
    head = _first_cut(lattice, text, a, b)
    if head is None:
        out = lattice.forward(text, _entries(lattice, text, a), b)
        return {(enter, leave): score for leave, paths in out.items() for enter, (score, _) in paths.items()}
    tail = _last_cut(lattice, text, head, b)
    into = {None: 0.0}
    if head > a:
        ends = lattice.forward(text, _entries(lattice, text, a), head)
        into = {}
        for state, paths in ends.items():
            if state and state[1] == head:
                for enter, (score, _) in paths.items():
                    into[enter] = max(score, into.get(enter, float("-inf")))
    between = 0.0
    if lattice.kind == "unigram" and tail > head:
        ends = lattice.forward(text[:tail], [(None, head)], tail)
        between = max(p[None][0] for s, p in ends.items() if s and s[1] == tail and None in p)
    leave = {None: 0.0}
    if tail < b:
        leave = {s: p[None][0] for s, p in lattice.forward(text, [(None, tail)], b).items() if None in p}
    return {(x, y): v + between + w for x, v in into.items() for y, w in leave.items()}


def combine(left: dict, right: dict) -> dict:
    """Max-plus product of two transfers (associative)."""
    by_enter: dict = {}
    for (enter, leave), weight in right.items():
        by_enter.setdefault(enter, []).append((leave, weight))
    out: dict = {}
    for (enter, middle), weight in left.items():
        for leave, more in by_enter.get(middle, ()):
            if weight + more > out.get((enter, leave), float("-inf")):
                out[enter, leave] = weight + more
    return out


def border_states(transfers: list[dict]) -> list[tuple]:
    """(enter, leave) of the best path for every chunk, from prefix and suffix products."""
    ahead = [{k: v for k, v in transfers[0].items() if k[0] is None}]
    for t in transfers[1:]:
        ahead.append(combine(ahead[-1], t))
    behind = [{k: v for k, v in transfers[-1].items() if k[1] is None}]
    for t in transfers[-2::-1]:
        behind.append(combine(t, behind[-1]))
    behind = behind[::-1]
    states = [None]
    for k in range(len(transfers) - 1):
        scores = {}
        for (_, state), w in ahead[k].items():
            rest = behind[k + 1].get((state, None))
            if rest is not None:
                scores[state] = max(w + rest, scores.get(state, float("-inf")))
        states.append(max(scores, key=lambda s: (scores[s], s or (-1, -1))))
    states.append(None)
    return list(itertools.pairwise(states))


def trace_back(lattice: Lattice, text: str, a: int, b: int, enter, leave) -> bytes:
    """Ids of the pieces that start in text[a:b] (and behind ``enter``), given the border pieces."""
    def ids(pieces) -> bytes:
        return b"".join(np.array(lattice.ids(text[x:y]), dtype=np.int32).tobytes() for x, y in pieces)

    start = a if enter is None else enter[1]
    head = _first_cut(lattice, text, max(a, start), b)
    if head is None:
        target = leave
        out = lattice.forward(text, [(enter, start)], b)
        return ids(lattice.path(target, enter)) if target in out and target != enter else b""
    tail = _last_cut(lattice, text, head, b)
    made = b""
    if head > start:
        ends = lattice.forward(text, [(enter, start)], head)
        best = max((s for s, p in ends.items() if s and s[1] == head and enter in p), key=lambda s: (ends[s][enter][0], s))
        if best != enter:
            made = ids(lattice.path(best, enter))
    made += b"".join(map(lattice.known.__getitem__, lattice.segments(text[head:tail])))
    if tail < b:
        lattice.forward(text, [(None, tail)], b)
        made += ids(lattice.path(leave, None))
    return made


def _rows(batch: pa.RecordBatch):
    return zip(*(batch.column(n).to_pylist() for n in batch.schema.names), strict=True)


def _state(state, by: int):
    return None if state is None else {"start": state[0] + by, "end": state[1] + by}


def _transfers(chunks: DataFrame, vocabulary, kind: str, chunk: int) -> DataFrame:
    def run(batches):
        lattice = _held(vocabulary, f"lattice-{kind}", lambda v: Lattice(v, kind))
        for batch in batches:
            rows = []
            for digest, k, total, start, offset, piece in _rows(batch):
                found = transfer(lattice, piece, start - offset, min(start + chunk, total) - offset)
                rows.append({"digest": digest, "k": k, "entries": [
                    {"enter": _state(x, offset), "leave": _state(y, offset), "weight": w} for (x, y), w in found.items()]})
            state = pa.struct([("start", pa.int64()), ("end", pa.int64())])
            entry = pa.struct([("enter", state), ("leave", state), ("weight", pa.float64())])
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(
                [("digest", pa.string()), ("k", pa.int32()), ("entries", pa.list_(entry))]))

    return chunks.select("digest", "k", "total", "start", "offset", "piece").mapInArrow(run, _TRANSFERS)


def _borders(transfers: DataFrame) -> DataFrame:
    """(digest, k, enter, leave).  A group is one document: at most its length / chunk small matrices."""
    def run(key, table):
        rows = sorted(table.to_pylist(), key=lambda r: r["k"])

        def plain(s):
            return None if s is None else (s["start"], s["end"])

        each = [{(plain(e["enter"]), plain(e["leave"])): e["weight"] for e in r["entries"]} for r in rows]
        found = border_states(each)
        state = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        return pa.table({
            "digest": pa.array([key[0].as_py()] * len(rows), pa.string()), "k": pa.array([r["k"] for r in rows], pa.int32()),
            "enter": pa.array([_state(x, 0) for x, _ in found], state), "leave": pa.array([_state(y, 0) for _, y in found], state)})

    return transfers.groupBy("digest").applyInArrow(run, f"digest string, k int, enter {_STATE}, leave {_STATE}")


def _traced(chunks: DataFrame, vocabulary, kind: str, chunk: int) -> DataFrame:
    def run(batches):
        lattice = _held(vocabulary, f"lattice-{kind}", lambda v: Lattice(v, kind))
        for batch in batches:
            digests, ks, parts = [], [], []
            for digest, k, total, start, offset, piece, enter, leave in _rows(batch):
                def local(s, offset=offset):
                    return None if s is None else (s["start"] - offset, s["end"] - offset)

                digests.append(digest)
                ks.append(k)
                parts.append(trace_back(lattice, piece, start - offset, min(start + chunk, total) - offset, local(enter), local(leave)))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(ks, pa.int32()), _id_lists(parts)],
                                             names=["digest", "k", "ids"])

    return chunks.select("digest", "k", "total", "start", "offset", "piece", "enter", "leave").mapInArrow(
        run, "digest string, k int, ids array<int>")


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", model_file: str = MODEL_FILE, kind: str = "bpe",
           chunk: int = CHUNK) -> DataFrame:
    """(key, n_tokens, ids) of every row."""
    spark = df.sparkSession
    vocabulary = broadcast_vocabulary(spark, model_file)
    context = max(map(len, vocabulary.value["pieces"]), default=1)
    if chunk <= context:
        raise ValueError("a chunk must be longer than the longest piece")
    d = df.select(F.col(key).cast("long").alias("row"), F.col(text).alias("text"))
    short = _encode_whole(d.filter(F.length("text") <= chunk), vocabulary, kind)
    none = d.filter(F.col("text").isNull()).select("row", F.lit(None).cast("array<int>").alias("ids"))

    long = d.filter(F.length("text") > chunk).select("row", F.sha2("text", 256).alias("digest"), "text")
    texts = long.groupBy("digest").agg(F.first("text").alias("text"))
    chunks = staged(_chunks(texts.select("digest", "text"), context, chunk), "pieces-chunks")
    # Chunks of one giant text go to different tasks.
    chunks = chunks.repartition("digest", "k")
    borders = staged(_borders(_transfers(chunks, vocabulary, kind, chunk)), "pieces-borders")
    traced = _traced(chunks.join(borders, ["digest", "k"]), vocabulary, kind, chunk)
    made = traced.groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("x")).select(
        "digest", F.flatten("x.ids").alias("ids"))
    giants = long.select("row", "digest").join(made, "digest").select("row", "ids")

    out = short.unionByName(none).unionByName(giants)
    n = F.when(F.col("ids").isNull(), 0).otherwise(F.size("ids")).cast("long")
    return out.select(F.col("row").alias(key), n.alias("n_tokens"), "ids")


def decode(df: DataFrame, key: str = "doc_id", ids: str = "ids", model_file: str = MODEL_FILE) -> DataFrame:
    """(key, text) of every row; null ids give a null text."""
    vocabulary = broadcast_vocabulary(df.sparkSession, model_file)

    def run(batches):
        decoder = _held(vocabulary, "decoder", Decoder)
        for batch in batches:
            keys, lists = batch.column(0), batch.column(1)
            texts, first, held = [], 0, 0
            for r, ids in enumerate(lists):
                texts.append(decoder.decode(ids.values.to_numpy().tolist()) if ids.is_valid else None)
                held += len(texts[-1] or "")
                if held >= EMIT or r == len(lists) - 1:
                    yield pa.RecordBatch.from_arrays([keys.slice(first, len(texts)), pa.array(texts, pa.string())], names=["row", "text"])
                    texts, first, held = [], r + 1, 0

    out = df.select(F.col(key).cast("long").alias("row"), F.col(ids).cast("array<int>").alias("ids")).mapInArrow(run, "row long, text string")
    return out.withColumnRenamed("row", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and the digest of the text that decoding them gives."""
    made = encode(read_table(spark, sf_dir, "documents"))
    vocabulary = broadcast_vocabulary(spark)

    def run(batches):
        decoder = _held(vocabulary, "decoder", Decoder)
        for batch in batches:
            shas = [hashlib.sha256(decoder.decode(i.values.to_numpy().tolist()).encode("utf-8", "replace")).hexdigest()
                    if i.is_valid else None for i in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shas, pa.string())], names=[*batch.schema.names, "decoded_sha256"])

    return made.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, decoded_sha256 string")
