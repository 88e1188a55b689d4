"""Alignment of two tokenizers' ids over a corpus.

Both tokenizers encode the same bytes of a text: inside tasks the public libraries
do, as encoding is not what this operator is about.  Byte offsets where tokens of
both end cut them into groups; every two tokens whose bytes overlap are a link,
and a pair of ids counts the documents that hold it linked.

* *Fast path*: an array computed once gives for every A id the B id with the
  same bytes.  Links of these pairs, the exact one-to-one groups, are counted by
  each task in one vector as long as the vocabulary; the vectors are summed.
* Only the other pairs, from irregular groups, are shuffled.  A task works on
  blocks of about ``BLOCK_BYTES`` of text and gives each pair once a block with
  the number of its documents, so the hottest pair has at most one row a block.
  Counts come back to the block they belong to, where its documents take them.

Tables between the steps are written to the shared folder.  What the driver
holds is bounded by the vocabulary: one count and one highest count per A id.

Defined cases: null and empty texts, and texts whose tokens do not give back
their bytes (a literal U+2581 among them), have no tokens and zeros; null and
repeated keys are passed on, row by row, and each row counts as a document; ties
for an id's highest count all are best; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmine.llm.byte_bpe import MAX_ENTRIES, PATTERN, load_ranks
from textmine.llm.common import read_table, staged
from textmine.llm.piece_lattice import Decoder, load_vocabulary
from textmine.llm.ragged import list_array, offsets_of, row_slices

A_FILE = public_tokenizers.path("byte_bpe_50k.json")
B_FILE = public_tokenizers.path("piece_bpe_32k.model")
BLOCK_BYTES = 16 << 20  # text whose irregular pairs are counted together
SLICE_BYTES = 1 << 20   # text that is aligned at a time

_DOCS = pa.schema([
    ("block", pa.int64()), ("row", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
    ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("same", pa.list_(pa.int32())), ("same_n", pa.list_(pa.int32())),
    ("other", pa.list_(pa.int32())), ("other_n", pa.list_(pa.int32())),
    ("pairs", pa.list_(pa.int64())), ("pair_docs", pa.list_(pa.int32()))])
_DOCS_DDL = ("block long, row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
             "same array<int>, same_n array<int>, other array<int>, other_n array<int>, pairs array<long>, pair_docs array<int>")
_RESULT = "row long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def identity_map(a_bytes: list[bytes], b_bytes: list[bytes], byte_ids: list[int]) -> np.ndarray:
    """B id with the same bytes for every A id, -1 for none; a whole piece goes before a byte's stand-in."""
    stand_in = set(byte_ids)
    where: dict[bytes, int] = {}
    for i in sorted(range(len(b_bytes)), key=lambda i: (i in stand_in, i)):
        where.setdefault(b_bytes[i], i)
    return np.array([where.get(t, -1) if t else -1 for t in a_bytes], dtype=np.int64)


def broadcast_vocabularies(spark: SparkSession, a_file: str = A_FILE, b_file: str = B_FILE):
    """Both vocabularies as plain values; their sizes are checked."""
    b = load_vocabulary(b_file)
    with open(b_file, "rb") as f:
        model = f.read()
    value = {"ranks": load_ranks(a_file), "pattern": PATTERN, "model": model, "b_bytes": Decoder(b).table, "stand_in": b["bytes"]}
    if max(len(value["ranks"]), len(value["b_bytes"])) > MAX_ENTRIES:
        raise ValueError("a vocabulary is too large to broadcast")
    return spark.sparkContext.broadcast(value)


class Aligner:
    """Both tokenizers and the tables of one pair of vocabularies, in a task's worker."""

    def __init__(self, value: dict):
        a_names = [b""] * (max(value["ranks"].values()) + 1)
        for token, i in value["ranks"].items():
            a_names[i] = token
        self.names = a_names, value["b_bytes"]
        self.lengths = tuple(np.array([len(t) for t in names], dtype=np.int64) for names in self.names)
        n_a, self.size_b = map(len, self.names)
        self.same = identity_map(*self.names, value["stand_in"])
        # Text of a token inside its side of a group and at the side's end, A before B.
        self.shown = [f"{i}{sign}".encode() for n, signs in ((n_a, ",|"), (self.size_b, ",;")) for sign in signs for i in range(n)]
        self.shown_at = (0, n_a, 2 * n_a, 2 * n_a + self.size_b)

    @classmethod
    def of(cls, broadcast) -> Aligner:
        value = broadcast.value
        if "aligner" not in value:
            made = value["aligner"] = cls(value)
            made.one = tiktoken.Encoding("a", pat_str=value["pattern"], mergeable_ranks=value["ranks"], special_tokens={})
            made.two = sentencepiece.SentencePieceProcessor(model_proto=value["model"])
        return value["aligner"]

    def tokens(self, texts: list[str | None]):
        """Ids of both sides and their offsets by text; none where the bytes of either side differ from space + text."""
        spaced = [" " + t if t else "" for t in texts]
        want = [t.encode() for t in spaced]
        lists = [self.one.encode_ordinary(t) for t in spaced], self.two.encode([t or "" for t in texts], num_threads=1)
        sides, good = [], np.ones(len(texts), dtype=bool)
        for names, found in zip(self.names, lists, strict=True):
            if b"".join(map(names.__getitem__, itertools.chain.from_iterable(found))) != b"".join(want):  # rare: which texts differ?
                good &= [b"".join(map(names.__getitem__, ids)) == text for ids, text in zip(found, want, strict=True)]
        for found in lists:
            n = np.array([len(ids) for ids in found], dtype=np.int64)
            ids = np.fromiter(itertools.chain.from_iterable(found), dtype=np.int64, count=n.sum())
            sides.append((ids[np.repeat(good, n)], offsets_of(np.where(good, n, 0))))
        return sides

    def align(self, texts: list[str | None]) -> dict:
        """Groups and links of texts; links as different (text, pair) with their number, in order.

        Works on one mark a byte of the joined texts: where tokens of either side end.
        """
        (a, a_at), (b, b_at) = self.tokens(texts)
        a_end, b_end = np.cumsum(self.lengths[0][a]), np.cumsum(self.lengths[1][b])
        text_end = np.concatenate([[0], a_end])[a_at][1:]
        size = int(a_end[-1]) + 1 if len(a_end) else 1
        in_a, in_b = np.zeros(size, dtype=bool), np.zeros(size, dtype=bool)
        in_a[a_end], in_b[b_end] = True, True
        either, both = in_a | in_b, in_a & in_b
        groups, links = np.cumsum(both), np.cumsum(either)  # up to and with a place
        # Between neighbouring ends of either side lie the bytes of one link, and of no other.
        ends = np.flatnonzero(either)
        pair = a[np.cumsum(in_a)[ends - 1]] * self.size_b + b[np.cumsum(in_b)[ends - 1]]
        n_links = np.diff(links[text_end], prepend=0)
        span = len(self.names[0]) * self.size_b
        key, number = np.unique(np.repeat(np.arange(len(texts)) * span, n_links) + pair, return_counts=True)
        return {"n_a": np.diff(a_at), "n_b": np.diff(b_at), "n_groups": np.diff(groups[text_end], prepend=0), "n_links": n_links,
                "sha": self._digests((a, groups[a_end - 1], both[a_end]), (b, groups[b_end - 1], both[b_end]), a_at + b_at),
                "text": key // span, "pair": key % span, "number": number}

    def _digests(self, a, b, token_at) -> list[str]:
        """Digest of each text's groups, `a1,a2|b1;a3|b2,b3`; a side is its ids, their groups, and which end a group."""
        (a, a_group, a_last), (b, b_group, b_last) = a, b
        n = int(a_group[-1]) + 1 if len(a_group) else 0
        a_until, b_until = (offsets_of(np.bincount(g, minlength=n)) for g in (a_group, b_group))
        shown = np.empty(len(a) + len(b), dtype=np.int64)
        # A token stands behind the B tokens of earlier groups, a B token behind the A tokens of its own group too.
        shown[np.arange(len(a)) + b_until[a_group]] = a + np.where(a_last, self.shown_at[1], self.shown_at[0])
        shown[np.arange(len(b)) + a_until[b_group + 1]] = b + np.where(b_last, self.shown_at[3], self.shown_at[2])
        out = []
        for x, y in zip(token_at[:-1].tolist(), token_at[1:].tolist(), strict=True):
            line = b"".join(map(self.shown.__getitem__, shown[x:y].tolist()))
            out.append(hashlib.sha256(line[:-1]).hexdigest() if line else "")
        return out


class _Block:
    """Aligned rows whose irregular pairs are counted together."""

    def __init__(self, number: int, same: np.ndarray, size_b: int):
        self.number, self.same, self.size_b = number, same, size_b
        self.rows: list = []
        self.links: list = []
        self.n = 0

    def add(self, keys: pa.Array, found: dict) -> None:
        self.links.append((found.pop("text") + self.n, found.pop("pair"), found.pop("number")))
        self.rows.append((keys, found))
        self.n += len(keys)

    def batches(self):
        text, pair, number = (np.concatenate(x) for x in zip(*self.links, strict=True))
        same = self.same[pair // self.size_b] == pair % self.size_b
        pairs, index, docs = np.unique(pair[~same], return_inverse=True, return_counts=True)
        lists = []
        for mask, values in ((same, pair[same] // self.size_b), (~same, index)):
            at = offsets_of(np.bincount(text[mask], minlength=self.n))
            lists += [list_array(values, at), list_array(number[mask], at)]

        def joined(name):
            return pa.array(np.concatenate([found[name] for _, found in self.rows]), pa.int64())

        sha = pa.array([s for _, found in self.rows for s in found["sha"]], pa.string())
        keys = pa.concat_arrays([keys for keys, _ in self.rows])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(self.n, self.number)), keys, *map(joined, ("n_a", "n_b", "n_groups", "n_links")), sha, *lists,
             pa.nulls(self.n, pa.list_(pa.int64())), pa.nulls(self.n, pa.list_(pa.int32()))], schema=_DOCS)
        yield pa.RecordBatch.from_arrays(
            [pa.array([self.number]), *(pa.nulls(1, f.type) for f in list(_DOCS)[1:11]),
             list_array(pairs, np.array([0, len(pairs)]), kind=pa.int64()), list_array(docs, np.array([0, len(pairs)]))], schema=_DOCS)


def _aligned(docs: DataFrame, vocabularies) -> DataFrame:
    """Rows of documents with their counted links, and a row of irregular pairs for each block."""
    def run(batches):
        aligner = Aligner.of(vocabularies)
        task, number, held, block = TaskContext.get().partitionId(), 0, 0, None
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for x, y in row_slices(texts, SLICE_BYTES):
                part = texts.slice(x, y - x)
                block = block or _Block(task << 32 | number, aligner.same, aligner.size_b)
                block.add(keys.slice(x, y - x), aligner.align(part.to_pylist()))
                held += pc.sum(pc.binary_length(part)).as_py() or 0
                if held >= BLOCK_BYTES:
                    yield from block.batches()
                    number, held, block = number + 1, 0, None
        if block:
            yield from block.batches()

    return docs.mapInArrow(run, _DOCS_DDL)


def _vector(rows: DataFrame, column: str, n: int) -> DataFrame:
    """(id, docs): each task counts the ids of a list column in a vector of length ``n``."""
    def run(batches):
        total = np.zeros(n, dtype=np.int64)
        for batch in batches:
            ids = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            total += np.bincount(ids, minlength=n)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["id", "docs"])

    return rows.select(column).mapInArrow(run, "id int, docs long").groupBy("id").agg(F.sum("docs").alias("docs"))


def _as_vector(rows: DataFrame, n: int) -> np.ndarray:
    """(id, value) rows, at most one an id of the vocabulary, as a vector."""
    out = np.zeros(n, dtype=np.int64)
    for r in rows.toLocalIterator():
        out[r[0]] = r[1]
    return out


def _row_sums(values: np.ndarray, lists: pa.ListArray) -> np.ndarray:
    """Sum of each list's stretch of ``values``, which stand for the flattened lists."""
    ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
    total = np.concatenate([[0], np.cumsum(values)])
    return np.diff(total[ends], prepend=0)


def align(df: DataFrame, key: str = "doc_id", text: str = "text", a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row."""
    out, _, _ = _align(df, key, text, a_file, b_file)
    return out


def pair_counts(df: DataFrame, key: str = "doc_id", text: str = "text", a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """(a, b, docs): the documents that hold each linked pair of ids."""
    _, same, other = _align(df, key, text, a_file, b_file)
    return same.unionByName(other)


def _align(df: DataFrame, key: str, text: str, a_file: str, b_file: str):
    spark = df.sparkSession
    vocabularies = broadcast_vocabularies(spark, a_file, b_file)
    tables = Aligner(vocabularies.value)
    n_a, size_b = len(tables.names[0]), tables.size_b
    same_b = spark.sparkContext.broadcast(tables.same)
    docs = df.select(F.col(key).cast("long").alias("row"), F.col(text).alias("text"))
    rows = staged(_aligned(docs, vocabularies), "align-rows")
    texts, blocks = rows.filter("pairs is null"), rows.filter("pairs is not null")

    same = _vector(texts, "same", n_a)
    each = blocks.select(F.col("block").alias("owner"), F.posexplode(F.arrays_zip("pairs", "pair_docs")).alias("at", "p")).select(
        "owner", "at", F.col("p.pairs").alias("pair"), F.col("p.pair_docs").alias("docs"))
    other = staged(each.groupBy("pair").agg(F.sum("docs").alias("docs")), "align-pairs")
    a_of = F.floor(F.col("pair") / F.lit(size_b)).cast("int")
    # One number an A id each: bounded by the vocabulary, whatever the corpus.
    same_count = _as_vector(same, n_a)
    highest = np.maximum(same_count, _as_vector(other.groupBy(a_of.alias("id")).agg(F.max("docs").alias("docs")), n_a))
    held = spark.sparkContext.broadcast((same_count, highest, size_b))

    counted = each.select("owner", "at", "pair").join(other, "pair").groupBy("owner").agg(
        F.sort_array(F.collect_list(F.struct("at", "pair", "docs"))).alias("x"))
    counted = counted.select("owner", F.col("x.pair").alias("pair"), F.col("x.docs").alias("docs"))

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        same_count, highest, size_b = held.value
        t = left.combine_chunks()
        pair, docs = (right.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("pair", "docs"))

        def flat(name):
            lists = t.column(name).combine_chunks()
            return lists, lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)

        best, total = np.zeros(len(t), dtype=np.int64), np.zeros(len(t), dtype=np.int64)
        lists, ids = flat("same")
        n = flat("same_n")[1]
        best += _row_sums(n * (same_count[ids] == highest[ids]), lists)
        total += _row_sums(n * same_count[ids], lists)
        lists, at = flat("other")
        n = flat("other_n")[1]
        best += _row_sums(n * (docs[at] == highest[pair[at] // size_b]), lists)
        total += _row_sums(n * docs[at], lists)
        return pa.table([t.column("row"), *(t.column(c) for c in ("n_a", "n_b", "n_groups", "n_links")), pa.array(best), pa.array(total),
                         t.column("groups_sha256")],
                        names=["row", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    sent = texts.drop("pairs", "pair_docs")
    out = sent.groupBy("block").cogroup(counted.groupBy("owner")).applyInArrow(finish, _RESULT).withColumnRenamed("row", key)

    def named(batches):
        for batch in batches:
            a = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(same_b.value[a].astype(np.int32)), batch.column(1)], names=["a", "b", "docs"])

    return out, same.mapInArrow(named, "a int, b int, docs long"), other.select(
        a_of.alias("a"), (F.col("pair") % size_b).cast("int").alias("b"), "docs")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups, links and counts of every document under the two public vocabularies."""
    return align(read_table(spark, sf_dir, "documents"))
