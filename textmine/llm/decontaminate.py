"""Benchmark decontamination by latent semantic retrieval.

The benchmark is a query set that is held against all rows, in blocks of
bounded size (one block for the given tables).  For each block:

1. *Passages*: documents are cut into passages of ``PASSAGE`` words (letters and
   digits, case aside).  Terms are the words of the block's items; one pass over
   all documents gives every term's passage frequency and, in the same pass, a
   randomised sketch of the passages' term-by-term matrix, summed by term.
2. *SVD*: the sketch gives the ``RANK`` leading singular directions of the TF-IDF
   passages (randomised SVD in Nystrom form, one pass), the latent space.  Items
   are cut into pieces of at most ``PASSAGE`` words and projected into it.
3. *Search*: every run of three half passages, in steps of half a passage and
   each word counted once a half, is projected as well; a cosine of ``COSINE``
   with a piece makes the item a candidate there.  A piece that keeps less than
   ``KEPT`` of its squared weight in the space cannot be told apart in it; its
   item goes the exact way instead, by its rarer words: all but the commonest
   ``COMMON`` of its words are looked up, and of a copy with ``LIKELY`` of the item
   so many must be among them within as many words as step 4 allows.
4. *Check*: the longest common subsequence of item and document around the
   candidate, within as many words as the item has over ``LIKELY``.  A share of
   ``CERTAIN`` of the item's words, or of ``LIKELY`` with ``ANSWER`` of its answer
   (its last sentence) in the same stretch, is contamination.

Defined cases: null and empty texts and items have no words and match nothing;
a row without id is searched like any other and reported with a null id; equal
rows and equal items are each reported; items of equal score are all checked;
empty tables give an empty result; other columns are not read
(``drop_contaminated`` passes them on).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmine.llm.common import read_table
from textmine.llm.wordhash import LOWER, PUNCTUATION, text_slices, word_hashes

PASSAGE = 32
RANK = 32          # directions of the latent space
EXTRA = 16         # oversampling of the randomised SVD
KEPT = 0.5         # share of its squared weight that a piece must keep to be searched in the space
COSINE = 0.5       # of a run with a piece, in the space
COMMON = 0.25      # of an item's words, the commonest, that the exact way does not look up
CERTAIN = 0.8
LIKELY, ANSWER = 0.6, 0.8
RUN = PASSAGE + PASSAGE // 2
STRETCHES = 4      # parts of an item's reach by which its rarer words are counted
BLOCK_ITEMS = 4096
BLOCK_WORDS = 131_072


def _tokens(data: np.ndarray, offsets: np.ndarray):
    hashes, bounds, _, _ = word_hashes(LOWER[data], offsets, PUNCTUATION)
    return hashes, bounds


def _words(text: str | None) -> np.ndarray:
    data = np.frombuffer((text or "").encode(), dtype=np.uint8)
    return _tokens(data, np.array([0, len(data)], dtype=np.int64))[0]


def _answer(text: str | None) -> str:
    """Last sentence of an item, the part that gives an answer away."""
    parts = [p for p in re.split(r"[.!?]\s+|\n+", (text or "").strip()) if p.strip()]
    return parts[-1] if parts else ""


def _lookup(terms: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Index in the sorted ``terms`` of each hash, -1 where it is none."""
    if not len(terms):
        return np.full(len(hashes), -1, dtype=np.int64)
    at = np.searchsorted(terms, hashes)
    at[at == len(terms)] = 0
    return np.where(terms[at] == hashes, at, -1)


class Block:
    """Items of one block: words, terms, and after ``fit`` the projection."""

    def __init__(self, rows):
        self.ids = [i for i, _ in rows]
        self.words = [_words(t) for _, t in rows]
        self.terms = np.unique(np.concatenate([*self.words, np.zeros(0, dtype=np.uint64)]))
        self.items = [_lookup(self.terms, w) for w in self.words]
        self.answers = [_lookup(self.terms, _words(_answer(t))) for _, t in rows]
        self.masks = [self._masks(i) for i in self.items]
        self.answer_masks = [self._masks(a) for a in self.answers]
        rng = np.random.default_rng(6)
        self.test = rng.standard_normal((len(self.terms), RANK + EXTRA)).astype(np.float32)

    @staticmethod
    def _masks(ids: np.ndarray) -> dict[int, int]:
        out: dict[int, int] = {}
        for place, term in enumerate(ids.tolist()):
            out[term] = out.get(term, 0) | 1 << place
        return out

    def fit(self, frequency: np.ndarray, sketch: np.ndarray, passages: int) -> None:
        """Projection from passage frequencies and the sketch CtC @ test over ``passages`` passages."""
        idf = np.log((passages + 1.0) / (frequency + 1.0)) + 0.1
        # Randomised SVD of the passages, TF-IDF: D CtC D with test matrix D^-1 test (Nystrom form).
        image = sketch * idf[:, None]
        core = self.test.T @ sketch
        values, vectors = np.linalg.eigh((core + core.T) / 2)
        keep = values > max(values.max(initial=0.0), 1e-12) * 1e-9
        space, _, _ = np.linalg.svd(image @ (vectors[:, keep] / np.sqrt(values[keep])), full_matrices=False)
        space = space[:, :RANK]
        pieces = [(item, piece) for item, ids in enumerate(self.items) if len(ids)
                  for piece in np.array_split(ids, -(-len(ids) // PASSAGE))]
        self.owner = np.array([item for item, _ in pieces], dtype=np.int64)
        self.reach = np.array([-(-len(ids) * 10 // 6) for ids in self.items], dtype=np.int64)
        queries, latent, lost, postings = [], [], set(), []
        for number, (item, ids) in enumerate(pieces):
            words = np.unique(ids)
            query = space[words].T @ idf[words]
            if query @ query >= KEPT * (idf[words] ** 2).sum():
                queries.append(query / np.linalg.norm(query))
                latent.append(number)
            else:
                lost.add(item)
        # Words that a stretch must hold, and the length of its parts: a copy lies within STRETCHES + 1 of them.
        self.need = np.zeros(len(self.items), dtype=np.int64)
        self.part = np.maximum(1, -(-(self.reach + 1) // STRETCHES))
        for item in sorted(lost):
            ids = self.items[item]
            words, often = np.unique(ids, return_counts=True)
            order = np.argsort(idf[words], kind="stable")
            rare = order[np.cumsum(often[order]) > COMMON * len(ids)]
            self.need[item] = max(1, -(-len(ids) * 6 // 10) - (len(ids) - often[rare].sum()))
            postings.append(np.stack([words[rare], np.full(len(rare), item)], axis=1))
        self.latent = np.array(latent, dtype=np.int64)
        self.queries = np.array(queries, dtype=np.float32).reshape(len(queries), space.shape[1])
        self.project = (space * idf[:, None]).astype(np.float32)
        flat = np.concatenate([*postings, np.zeros((0, 2), dtype=np.int64)])
        flat = flat[np.argsort(flat[:, 0], kind="stable")]
        self.posted = flat[:, 1]
        self.posted_at = np.searchsorted(flat[:, 0], np.arange(len(self.terms) + 1))
        self.test = None

    def _rare_words(self, ids: np.ndarray, bounds: np.ndarray):
        """(row, first word, words, item) of the stretches that hold enough rarer words of an item."""
        at = np.flatnonzero(ids >= 0)
        first = self.posted_at[ids[at]]
        many = self.posted_at[ids[at] + 1] - first
        at, first, many = at[many > 0], first[many > 0], many[many > 0]
        if not len(at):
            return
        ends = np.cumsum(many)
        item = self.posted[np.arange(ends[-1]) + np.repeat(first - ends + many, many)]
        row = np.searchsorted(bounds, at, side="right") - 1
        apart = (STRETCHES + 2) * int(self.part.max())  # so that no stretch reaches into the next row
        place = at + row * apart
        size = int(place[-1]) + 1
        key, n = np.unique(item * size + np.repeat(place, many) // self.part[item], return_counts=True)
        total = np.concatenate([[0], np.cumsum(n)])
        item = key // size
        inside = total[np.searchsorted(key, key + STRETCHES, side="right")] - total[:-1]
        found = np.flatnonzero(inside >= self.need[item])
        item = item[found]
        start = (key[found] - item * size) * self.part[item]
        row = np.searchsorted(bounds[:-1] + np.arange(len(bounds) - 1) * apart, start + self.part[item] - 1, side="right") - 1
        first = np.maximum(start - bounds[row] - row * apart, 0)
        yield from zip(row.tolist(), first.tolist(), ((STRETCHES + 1) * self.part[item]).tolist(), item.tolist(), strict=True)

    def _near(self, ids: np.ndarray, bounds: np.ndarray):
        """(row, first word, words, item) of the runs of three half passages that lie near a piece in the latent space."""
        at = np.flatnonzero(ids >= 0)
        if not len(self.latent) or not len(at):
            return
        half = PASSAGE // 2
        row = np.searchsorted(bounds, at, side="right") - 1
        base = np.concatenate([[0], np.cumsum(-(-np.diff(bounds) // half) + 2)])  # two empty halves between rows
        block, term = np.divmod(np.unique((base[row] + (at - bounds[row]) // half) * len(self.terms) + ids[at]), len(self.terms))
        first = np.flatnonzero(np.diff(block, prepend=-1))
        sums = np.zeros((base[-1] + 2, self.project.shape[1]), dtype=np.float32)
        sums[block[first]] = np.add.reduceat(self.project[term], first, axis=0)
        sums = sums[:-2] + sums[1:-1] + sums[2:]
        some = np.flatnonzero((sums != 0).any(axis=1))
        for start in range(0, len(some), 4096):
            part = some[start:start + 4096]
            cosine = (sums[part] / np.linalg.norm(sums[part], axis=1, keepdims=True)) @ self.queries.T
            run, query = np.nonzero(cosine >= COSINE)
            row = np.searchsorted(base, part[run], side="right") - 1
            where = np.minimum(part[run] - base[row], np.maximum(-(-np.diff(bounds)[row] // half) - 1, 0)) * half
            yield from zip(row.tolist(), where.tolist(), [RUN] * len(row), self.owner[self.latent[query]].tolist(), strict=True)

    def candidates(self, ids: np.ndarray, bounds: np.ndarray) -> dict[tuple[int, int], list[tuple[int, int]]]:
        """(row, item) -> (first word, words) of the stretches that come near the item, ascending."""
        out: dict[tuple[int, int], set] = {}
        for way in (self._rare_words, self._near):
            for row, start, words, item in way(ids, bounds):
                out.setdefault((row, item), set()).add((start, words))
        return {key: sorted(found) for key, found in sorted(out.items())}

    def matches(self, ids: np.ndarray, bounds: np.ndarray | None = None) -> list[tuple[int, ...]]:
        """(item, common words, common words of the answer) of the contaminating items, behind the row where there are bounds."""
        out = []
        spans = np.array([0, len(ids)]) if bounds is None else bounds
        for (row, item), starts in self.candidates(ids, spans).items():
            own = ids[spans[row]:spans[row + 1]]
            found = [m for a, b in _regions(starts, int(self.reach[item]), len(own)) if (m := self._checked(item, own[a:b].tolist()))]
            if found:
                out.append((item, *max(found)) if bounds is None else (row, item, *max(found)))
        return out

    def _checked(self, item: int, region: list[int]) -> tuple[int, int] | None:
        """Best (common, answer) of the region's stretches that contaminate, or none."""
        n, masks = len(self.items[item]), self.masks[item]
        if _common(masks, n, region) < LIKELY * n:
            return None
        step = max(1, n // 32)  # long items: stretches a little longer, in steps
        width = int(self.reach[item]) + step - 1
        best = None
        for a in range(0, max(1, len(region) - int(LIKELY * n) + step), step):
            stretch = region[a:a + width]
            if step == 1 and stretch[:1] and stretch[0] not in masks:
                continue  # a best stretch starts with a word of the item
            found = _common(masks, n, stretch)
            if found < LIKELY * n:
                continue
            answer = _common(self.answer_masks[item], len(self.answers[item]), stretch)
            if found >= CERTAIN * n or answer >= ANSWER * len(self.answers[item]):
                best = max(best or (0, 0), (found, answer))
        return best


def _regions(found: list[tuple[int, int]], around: int, n: int) -> list[tuple[int, int]]:
    """Surroundings of candidate stretches; touching ones share one, not much longer than item and stretch."""
    out = []
    for start, words in found:
        a, b = max(0, start - around), min(n, start + words + around)
        if out and start <= out[-1][2] + words and b - out[-1][0] <= 2 * around + 2 * words:
            out[-1] = (out[-1][0], b, start)
        else:
            out.append((a, b, start))
    return [(a, b) for a, b, _ in out]


def _common(masks: dict[int, int], n: int, words: list[int]) -> int:
    """Length of the longest common subsequence, one machine-word step for each matching word."""
    full = (1 << n) - 1
    row = full
    for w in words:
        mask = masks.get(w)
        if mask:
            hit = row & mask
            row = ((row + hit) | (row - hit)) & full
    return n - row.bit_count()


def _sketch(docs: DataFrame, block, width: int) -> DataFrame:
    """(term, frequency, c0..): the task sums of every partition, a row for each term; term -1 counts passages."""
    def run(batches):
        b = block.value
        terms, test = b.terms, b.test
        frequency = np.zeros(len(terms))
        image = np.zeros((len(terms), width))
        passages = 0
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(0)):
                hashes, bounds = _tokens(data, offsets)
                ids = _lookup(terms, hashes)
                # Number the passages of the slice: they start anew in each row.
                lengths = np.diff(bounds)
                each = -(-lengths // PASSAGE)
                row = np.repeat(np.arange(len(lengths)), lengths)
                passage = (np.cumsum(each) - each)[row] + (np.arange(len(ids)) - bounds[:-1][row]) // PASSAGE
                passages += int(each.sum())
                known = ids >= 0
                pair = np.unique(passage[known] * len(terms) + ids[known]) if known.any() else np.zeros(0, dtype=np.int64)
                if not len(pair):
                    continue
                passage, term = np.divmod(pair, len(terms))
                frequency += np.bincount(term, minlength=len(terms))
                first = np.flatnonzero(np.diff(passage, prepend=-1))
                rows = np.add.reduceat(test[term], first, axis=0)       # C @ test
                order = np.argsort(term, kind="stable")
                term = term[order]
                rows = rows[(np.cumsum(np.diff(passage, prepend=-1) != 0) - 1)[order]]
                first = np.flatnonzero(np.diff(term, prepend=-1))
                image[term[first]] += np.add.reduceat(rows, first, axis=0)  # Ct @ (C @ test)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(-1, len(terms), dtype=np.int32)), pa.array(np.concatenate([[passages], frequency])),
             *[pa.array(np.concatenate([[0.0], image[:, c]])) for c in range(width)]],
            names=["term", "frequency", *[f"c{c}" for c in range(width)]])

    columns = ", ".join(f"c{c} double" for c in range(width))
    return docs.mapInArrow(run, f"term int, frequency double, {columns}")


def blocks_of(benchmark: DataFrame, item_key: str = "item_id", text: str = "text"):
    """Benchmark items in blocks of at most ``BLOCK_ITEMS`` items and about ``BLOCK_WORDS`` words."""
    held, size = [], 0
    for row in benchmark.select(F.col(item_key).cast("long").alias("i"), F.col(text).alias("t")).orderBy("i", "t").toLocalIterator():
        n = len((row.t or "").split())
        if held and (len(held) >= BLOCK_ITEMS or size + n > BLOCK_WORDS):
            yield held
            held, size = [], 0
        held.append((row.i, row.t))
        size += n
    if held:
        yield held


def fitted_blocks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> list:
    """A broadcast, fitted ``Block`` for every block of the benchmark."""
    spark = docs.sparkSession
    out = []
    for rows in blocks_of(benchmark):
        block = Block(rows)
        if not len(block.terms):
            continue
        width = RANK + EXTRA
        sent = spark.sparkContext.broadcast(block)
        sums = _sketch(docs.select(F.col(text).alias("text")), sent, width).groupBy("term").agg(
            F.sum("frequency").alias("frequency"), *[F.sum(f"c{c}").alias(f"c{c}") for c in range(width)])
        # One row for each term of the block: bounded by BLOCK_WORDS.
        table = np.zeros((len(block.terms) + 1, width + 1))
        for row in sums.toLocalIterator():
            table[row[0] + 1] = row[1:]
        sent.unpersist()
        block.fit(table[1:, 0], table[1:, 1:], int(table[0, 0]))
        out.append(spark.sparkContext.broadcast(block))
    return out


def _batch_matches(block: Block, col: pa.Array):
    """(row of the batch, item, common, answer) of every contamination."""
    for a, b, data, offsets in text_slices(col):
        hashes, bounds = _tokens(data, offsets)
        ids = _lookup(block.terms, hashes)
        for row, *found in block.matches(ids, bounds):
            yield a + row, *found


def search(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, item_id, n_words, common, answer_words, answer_common) of every contaminated row and item."""
    schema = "row long, item_id long, n_words long, common long, answer_words long, answer_common long"
    d = docs.select(F.col(key).cast("long").alias("row"), F.col(text).alias("text"))
    out = None
    for sent in fitted_blocks(docs, benchmark, text):
        def run(batches, sent=sent):
            block = sent.value
            for batch in batches:
                found = list(_batch_matches(block, batch.column(1)))
                rows = batch.column(0).take(pa.array([f[0] for f in found], pa.int64()))
                cols = [[block.ids[f[1]] for f in found], [len(block.items[f[1]]) for f in found], [f[2] for f in found],
                        [len(block.answers[f[1]]) for f in found], [f[3] for f in found]]
                yield pa.RecordBatch.from_arrays([rows, *[pa.array(c, pa.int64()) for c in cols]],
                                                 names=["row", "item_id", "n_words", "common", "answer_words", "answer_common"])

        part = d.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    out = out if out is not None else docs.sparkSession.createDataFrame([], schema)
    return out.withColumnRenamed("row", key)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that no benchmark item contaminates: filtered in place, no shuffle."""
    for sent in fitted_blocks(docs, benchmark, text):
        def run(batches, sent=sent):
            block = sent.value
            for batch in batches:
                bad = {f[0] for f in _batch_matches(block, batch.column(batch.schema.get_field_index(text)))}
                yield batch.filter(pa.array([r not in bad for r in range(batch.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
