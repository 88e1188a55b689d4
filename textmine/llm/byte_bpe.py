"""Byte-level BPE encoding and decoding with a two-tier lookup.

A text is cut into pre-tokens by the tokenizer's pattern; each is encoded alone.

1. The different pre-tokens of a batch are looked up together in a minimal
   perfect hash over the vocabulary: a level of bits holds the keys that no
   other key meets there, the others go one level down, and counting the bits
   before a key numbers the keys from 0 without a gap.  The entry found is
   compared byte for byte, so a foreign word never passes.
2. A pre-token that is no entry is merged over its linked bytes: a heap holds
   the neighbouring pairs by rank, then by place; the merged pair's neighbours
   enter anew, and entries that no longer stand for neighbours are passed over.
   n bytes take n log n steps, however long a pre-token is.

The vocabulary is read on the driver from ``model_file`` and broadcast; its
number of entries is checked.  Every batch is worked on in slices of whole rows,
so memory follows the slice or the longest text, and a task keeps at most
``MEMO`` merged pre-tokens.  Nothing is shuffled: a lost task is simply run again.

Defined cases: a null text is an empty one, which has no ids; null and repeated
keys are passed on, row by row; equal ranks do not exist, of one rank the
leftmost pair is merged first; an empty table gives an empty result; other
columns are not read.  Special tokens are not known: their strings are plain text.
"""

from __future__ import annotations

import base64
import hashlib
import json
from array import array
from heapq import heapify, heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmine.llm.common import read_table
from textmine.llm.ragged import distinct, gather, list_array, offsets_of, row_slices
from textmine.llm.wordhash import _hash_spans, mix

MODEL_FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
MAX_ENTRIES = 1_000_000  # vocabulary entries that may be broadcast
GAMMA = 2.0              # bits of a level for each key that it is offered
MEMO = 500_000           # merged pre-tokens that a task remembers (about 100 MB)


# ------------------------------------------------------------------ vocabulary
def _byte_letters() -> dict[str, int]:
    """Letter -> byte of the byte-level alphabet: printable bytes stand for themselves, the rest follow from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def load_ranks(model_file: str) -> dict[bytes, int]:
    """Token bytes -> id (= rank) from a file of base64 ranks or a tokenizer's JSON (driver side)."""
    if model_file.endswith(".json"):
        with open(model_file, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letter = _byte_letters()
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in model["merges"]]
        order = [model["vocab"][m] for m in merged]
        if order != sorted(order) or len(set(order)) != len(order):
            raise ValueError("the merges do not stand in the order of their ids")
        single = [t for t in model["vocab"] if len(t) == 1 and t in letter]
        return {bytes(letter[c] for c in t): model["vocab"][t] for t in [*single, *merged]}
    with open(model_file, "rb") as f:
        return {base64.b64decode(t): int(i) for t, i in (line.split() for line in f if line.strip())}


def _hashes(keys: pa.Array) -> np.ndarray:
    """64-bit hash of each string of a large binary array."""
    n = len(keys)
    offsets = np.frombuffer(keys.buffers()[1], dtype=np.int64)[keys.offset:keys.offset + n + 1]
    raw = keys.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, dtype=np.uint8)
    return _hash_spans(data, offsets[:-1], offsets[1:])


class PerfectHash:
    """Minimal perfect hash over different byte strings: ``find`` numbers them 0 .. n-1 by ``order``."""

    def __init__(self, keys: list[bytes]):
        left = _hashes(pa.array(keys, pa.large_binary()))
        if len(np.unique(left)) != len(keys):
            raise ValueError("two keys share a hash value")
        self.levels: list[tuple[np.ndarray, int]] = []  # (number of the key at a place or -1, seed)
        place, done = np.arange(len(keys)), 0
        order = []
        while len(left):
            seed = int(mix(np.array([len(self.levels) + 1], dtype=np.uint64))[0])
            size = max(1, int(GAMMA * len(left)))
            at = self._at(left, seed, size)
            alone = np.bincount(at, minlength=size)[at] == 1
            bits = np.zeros(size, dtype=bool)
            bits[at[alone]] = True
            numbers = np.where(bits, done + np.cumsum(bits) - 1, -1).astype(np.int32)
            kept = place[alone]
            order.append(kept[np.argsort(at[alone])])
            self.levels.append((numbers, seed))
            done += int(bits.sum())
            left, place = left[~alone], place[~alone]
        self.order = np.concatenate([*order, np.zeros(0, dtype=np.int64)])
        self.keys = pa.array([keys[i] for i in self.order], pa.large_binary())

    @staticmethod
    def _at(hashes: np.ndarray, seed: int, size: int) -> np.ndarray:
        return (mix(hashes ^ np.uint64(seed)) % np.uint64(size)).astype(np.int64)

    def find(self, words: pa.Array) -> np.ndarray:
        """Number of each word of a large binary array; -1 for a word that is no key."""
        hashes = _hashes(words)
        out = np.full(len(words), -1, dtype=np.int64)
        open_ = np.arange(len(words))
        for numbers, seed in self.levels:
            got = numbers[self._at(hashes[open_], seed, len(numbers))]
            out[open_[got >= 0]] = got[got >= 0]
            open_ = open_[got < 0]
        found = np.flatnonzero(out >= 0)
        same = pc.equal(self.keys.take(pa.array(out[found])), words.take(pa.array(found)))
        out[found[~same.to_numpy(zero_copy_only=False)]] = -1
        return out


def broadcast_vocabulary(spark: SparkSession, model_file: str = MODEL_FILE, pattern: str = PATTERN):
    ranks = load_ranks(model_file)
    if len(ranks) > MAX_ENTRIES:
        raise ValueError("vocabulary is too large to broadcast")
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"bytes without a token: {missing}")
    return spark.sparkContext.broadcast({"ranks": ranks, "hash": PerfectHash(list(ranks)), "pattern": pattern})


# -------------------------------------------------------------------- encoding
def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word by merging its linked bytes, lowest rank first, leftmost first among equals."""
    n, rank = len(word), ranks.get
    if n < 2:
        return [ranks[word]] if n else []
    bits = (n + 1).bit_length()
    mask = (1 << bits) - 1
    after = list(range(1, n + 2))  # where the part that starts here ends; 0 once it is no start
    before = list(range(-1, n))    # start of the part in front
    # One integer a pair: its rank, its start, its end.
    heap = [(r << bits | i) << bits | i + 2 for i in range(n - 1) if (r := rank(word[i:i + 2])) is not None]
    heapify(heap)
    while heap:
        entry = heappop(heap)
        i, end = entry >> bits & mask, entry & mask
        middle = after[i]
        # An entry stands while two neighbouring parts span i .. end, whichever they are.
        if not middle or middle >= n or after[middle] != end:
            continue
        after[i], after[middle] = end, 0
        if end < n:
            before[end] = i
            stop = after[end]
            if (r := rank(word[i:stop])) is not None:
                heappush(heap, (r << bits | i) << bits | stop)
        if (left := before[i]) >= 0 and (r := rank(word[left:end])) is not None:
            heappush(heap, (r << bits | left) << bits | end)
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i:after[i]]])
        i = after[i]
    return out


class ByteBpe:
    """Encoder and decoder of one vocabulary; lives in a task's worker beside the broadcast value."""

    def __init__(self, vocabulary: dict):
        self.ranks, self.hash = vocabulary["ranks"], vocabulary["hash"]
        # White space is the Unicode property, with which the library's pattern agrees.
        pattern = vocabulary["pattern"].replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self.pieces = regex.compile(pattern).findall
        entries = list(self.ranks.items())
        self.ids = np.array([entries[i][1] for i in self.hash.order], dtype=np.int32)
        self.names = [b""] * (max(self.ranks.values()) + 1)
        for token, i in entries:
            self.names[i] = token
        self.merged: dict[bytes, bytes] = {}  # miss -> ids as native 32-bit integers

    @classmethod
    def of(cls, broadcast) -> ByteBpe:
        value = broadcast.value
        if "coder" not in value:
            value["coder"] = cls(value)
        return value["coder"]

    def _merge(self, word: bytes) -> bytes:
        ids = self.merged.get(word)
        if ids is None:
            ids = array("i", merge(word, self.ranks)).tobytes()
            if len(word) <= 64:
                if len(self.merged) >= MEMO:
                    self.merged.clear()
                self.merged[word] = ids
        return ids

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different pre-tokens as (values, offsets): the hash first, the heap for what it lacks."""
        words = words.cast(pa.large_binary())
        number = self.hash.find(words)
        misses = np.flatnonzero(number < 0)
        made = [self._merge(w) for w in words.take(pa.array(misses)).to_pylist()]
        lengths = np.ones(len(words), dtype=np.int64)
        lengths[misses] = [len(m) // 4 for m in made]
        offsets = offsets_of(lengths)
        ids = np.empty(offsets[-1], dtype=np.int32)
        hits = number >= 0
        ids[offsets[:-1][hits]] = self.ids[number[hits]]
        if made:
            flat = np.frombuffer(b"".join(made), dtype=np.int32)
            inside = offsets_of(lengths[misses])
            ids[np.arange(len(flat)) + np.repeat(offsets[misses] - inside[:-1], lengths[misses])] = flat
        return ids, offsets

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts as (values, offsets)."""
        words: list[str] = []
        counts = []
        for text in texts:
            found = self.pieces(text)
            words += found
            counts.append(len(found))
        if not words:
            return np.zeros(0, dtype=np.int32), np.zeros(len(texts) + 1, dtype=np.int64)
        known, codes = distinct(words)
        ids, ends = gather(*self.encode_words(known), codes)
        return ids, ends[offsets_of(counts)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.names.__getitem__, ids))


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", model_file: str = MODEL_FILE,
           pattern: str = PATTERN) -> DataFrame:
    """(key, n_tokens, ids) of every row."""
    vocabulary = broadcast_vocabulary(df.sparkSession, model_file, pattern)

    def run(batches):
        coder = ByteBpe.of(vocabulary)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for a, b in row_slices(texts):
                ids, offsets = coder.encode(texts.slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(a, b - a), pa.array(np.diff(offsets)), list_array(ids, offsets)], names=["row", "n_tokens", "ids"])

    out = df.select(F.col(key).cast("long").alias("row"), F.coalesce(text, F.lit("")).alias("text")).mapInArrow(
        run, "row long, n_tokens long, ids array<int>")
    return out.withColumnRenamed("row", key)


def decode(df: DataFrame, key: str = "doc_id", ids: str = "ids", model_file: str = MODEL_FILE) -> DataFrame:
    """(key, payload): the bytes of every row's ids; null ids have none."""
    vocabulary = broadcast_vocabulary(df.sparkSession, model_file)

    def run(batches):
        coder = ByteBpe.of(vocabulary)
        for batch in batches:
            keys = batch.column(0)
            for r, ids in enumerate(batch.column(1)):
                payload = coder.decode(ids.values.to_numpy().tolist()) if ids.is_valid else b""
                yield pa.RecordBatch.from_arrays([keys.slice(r, 1), pa.array([payload], pa.binary())], names=["row", "payload"])

    out = df.select(F.col(key).cast("long").alias("row"), F.col(ids).cast("array<int>").alias("ids")).mapInArrow(run, "row long, payload binary")
    return out.withColumnRenamed("row", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digest of every document's ids, and the digest of what decoding them gives."""
    made = encode(read_table(spark, sf_dir, "documents"))
    vocabulary = broadcast_vocabulary(spark)

    def run(batches):
        coder = ByteBpe.of(vocabulary)
        decimal = [str(i).encode() for i in range(len(coder.names))]
        for batch in batches:
            lists = [ids.values.to_numpy().tolist() for ids in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1),
                 pa.array([hashlib.sha256(b" ".join(map(decimal.__getitem__, ids))).hexdigest() for ids in lists], pa.string()),
                 pa.array([hashlib.sha256(coder.decode(ids)).hexdigest() for ids in lists], pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return made.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
