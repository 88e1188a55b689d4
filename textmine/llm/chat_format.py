"""Chat formatting: roles of a transcript by a hidden Markov model, then canonical turns.

A transcript is the lines of a conversation in order; only the first line of a
turn carries a speaker marker (``User:``), if any.  The hidden state of a line is
its role and whether it begins a turn; the observations are the marker and the
line's length and end.  Probabilities are counted from the lines whose role is
known, over the whole table; Viterbi gives the roles, and every recovered turn
is rendered as ``<|role|>``, a line end, its text without marker, ``<|end|>``.

A conversation may be of any length, so it is not gathered: rows are sorted by
range over (conversation, turn), cut into *blocks* of at most ``BLOCK_ROWS`` rows
(or ``BLOCK_CHARS`` characters) inside a partition, and a block's max-plus matrix
of best paths between states stands for it.  Matrices are combined first by
(conversation, partition), then by conversation over partitions, which fixes the
states at all block borders; blocks are then traced back on their own.

Defined cases: a null text is an empty line; a null conversation id is a
conversation of its own, a null turn comes first; rows that share conversation
and turn are ordered by a hash of role and text, repeated rows stay repeated; a
null or unknown role gives no marker and is recovered; of equally good paths
the first state in order wins; an empty table gives an empty result; other
columns are not read.  The pieces of a recovered turn that crosses block borders
are joined again, so ``part`` is always 0 and no result depends on the blocks.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textmine.llm.common import partitions, read_table, staged

ROLES = ("system", "user", "assistant")
# Speaker markers in transcripts and the role that each names.
MARKERS = {
    "system": "system", "instructions": "system",
    "user": "user", "human": "user", "question": "user", "q": "user",
    "assistant": "assistant", "ai": "assistant", "bot": "assistant", "answer": "assistant", "a": "assistant",
}
STATES = [(role, begin) for role in ROLES for begin in (True, False)]
BLOCK_ROWS, BLOCK_CHARS = 512, 1 << 20
_MARKER = re.compile(r"\s*[*#>]*\s*([A-Za-z]{1,12})[*]*\s*:\s?")
_LENGTHS = (0, 20, 80, 200)
N_SHAPES = (len(_LENGTHS) + 1) * 2


def marker_of(line: str) -> tuple[str | None, str]:
    """(role that the line's speaker marker names or None, the line without it)."""
    found = _MARKER.match(line)
    role = MARKERS.get(found[1].lower()) if found else None
    return (role, line[found.end():]) if role else (None, line)


def shape_of(line: str) -> int:
    """Class of a line by its length and whether it ends as a question."""
    return sum(len(line) > n for n in _LENGTHS) * 2 + line.rstrip().endswith("?")


def transcript_lines(role: str | None, text: str | None) -> list[str]:
    """Lines of one utterance as a transcript has them."""
    lines = (text or "").split("\n")
    return [f"{role.capitalize()}: {lines[0]}", *lines[1:]] if role in ROLES else lines


class Hmm:
    """Log probabilities: ``start``, ``step`` (state, state), ``marker`` (state, marker), ``shape`` (state, shape)."""

    def __init__(self, counts: dict, smooth: float = 0.5):
        def table(kind, width, allowed=None):
            out = np.full((len(STATES), width), smooth)
            for (k, a, b), n in counts.items():
                if k == kind:
                    out[a, b] += n
            if allowed is not None:
                out = np.where(allowed, out, 0.0)
            with np.errstate(divide="ignore"):
                return np.log(out) - np.log(out.sum(axis=1, keepdims=True))

        same = np.array([[b or r == s for s, b in STATES] for r, _ in STATES])  # a turn goes on in its own role only
        self.step = table("step", len(STATES), same)
        self.marker = table("marker", len(ROLES) + 1)
        self.shape = table("shape", N_SHAPES)
        first = np.array([counts.get(("start", 0, s), 0.0) + smooth if begin else 0.0 for s, (_, begin) in enumerate(STATES)])
        with np.errstate(divide="ignore"):
            self.start = np.log(first / first.sum())

    def emissions(self, lines: list[str]) -> np.ndarray:
        marks = [marker_of(line)[0] for line in lines]
        mark = [ROLES.index(m) if m else len(ROLES) for m in marks]
        return self.marker[:, mark].T + self.shape[:, [shape_of(line) for line in lines]].T

    def transfer(self, lines: list[str], first: bool) -> np.ndarray:
        """Max-plus matrix of a stretch: state before it -> its last state (row 0 only at the start of a conversation)."""
        emit = self.emissions(lines)
        if first:
            best = np.full((len(STATES), len(STATES)), -np.inf)
            best[0] = self.start + emit[0]
        else:
            best = self.step + emit[0]
        for e in emit[1:]:
            best = (best[:, :, None] + self.step[None]).max(axis=1) + e
        return best

    def path(self, lines: list[str], before: int | None, last: int | None) -> list[int]:
        """Best states of a stretch between the state before it and its last state (None: free)."""
        emit = self.emissions(lines)
        score = (self.start if before is None else self.step[before]) + emit[0]
        back = []
        for e in emit[1:]:
            through = score[:, None] + self.step
            back.append(through.argmax(axis=0))
            score = through.max(axis=0) + e
        states = [int(score.argmax()) if last is None else last]
        for b in reversed(back):
            states.append(int(b[states[-1]]))
        return states[::-1]


def product(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Max-plus product of two transfer matrices (associative)."""
    return (left[:, :, None] + right[None]).max(axis=1)


def borders(matrices: list[np.ndarray], before: int | None, last: int | None) -> list[tuple[int | None, int]]:
    """(state before, last state) of every stretch on the best path through all of them."""
    ahead = list(itertools.accumulate(matrices, product))
    behind = list(itertools.accumulate(matrices[::-1], lambda a, b: product(b, a)))[::-1]
    row = before or 0
    ends = []
    for k in range(len(matrices)):
        if k == len(matrices) - 1:
            ends.append(int(ahead[k][row].argmax()) if last is None else last)
        else:
            rest = behind[k + 1]
            ends.append(int((ahead[k][row] + (rest.max(axis=1) if last is None else rest[:, last])).argmax()))
    return list(zip([before, *ends[:-1]], ends, strict=True))


_ROW = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
_ROWS = "array<struct<turn:long,role:string,text:string>>"


_UNKNOWN, _OPEN = -1, -2


def _first_state(row) -> int:
    return STATES.index((row["role"], True)) if row["role"] in ROLES else _UNKNOWN


def _last_state(row) -> int:
    """State of a row's last line."""
    first = _first_state(row)
    return first if first == _UNKNOWN else first + (len(transcript_lines(row["role"], row["text"])) > 1)


def blocks(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, part, block, before, rows): consecutive rows of one conversation, in order of (part, block).

    ``before`` is the state of the line before (``_UNKNOWN``: its role is not
    known), null at the start of a conversation, ``_OPEN`` at the start of a
    partition, where the conversation may have begun in an earlier one.
    """
    d = df.select(F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"),
                  F.lower(F.trim(role)).alias("role"), F.col(text).alias("text"))
    d = d.withColumn("tie", F.xxhash64("role", "text")).withColumn("copy", F.monotonically_increasing_id())
    order = ["conv", "turn", "tie", "copy"]
    d = d.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*order)

    def run(batches):
        part, block = TaskContext.get().partitionId(), 0
        now, rows, size, before = None, [], 0, _OPEN

        def out():
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([part], pa.int32()), pa.array([block], pa.int32()),
                                               pa.array([before], pa.int32()), pa.array([rows], pa.list_(_ROW))], names=["conv", "part", "block", "before", "rows"])

        for batch in batches:
            for c, t, r, x in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if rows and (now != (c,) or len(rows) >= BLOCK_ROWS or size >= BLOCK_CHARS):
                    yield out()
                    before = _last_state(rows[-1]) if now == (c,) else None
                    rows, size, block = [], 0, block + 1
                now = (c,)
                rows.append({"turn": t, "role": r, "text": x})
                size += len(x or "")
        if rows:
            yield out()

    return d.select("conv", "turn", "role", "text").mapInArrow(run, f"conv long, part int, block int, before int, rows {_ROWS}")


def _each(batch: pa.RecordBatch):
    return zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True)


def train(held: DataFrame) -> Hmm:
    """Counts over all rows with a known role (a bounded table of states and observations)."""
    def run(batches):
        counts: dict = {}

        def add(kind, a, b):
            counts[kind, a, b] = counts.get((kind, a, b), 0) + 1

        for batch in batches:
            for before, rows in _each(batch):
                last = before
                for row in rows:
                    if row["role"] not in ROLES:
                        last = _UNKNOWN
                        continue
                    begin = STATES.index((row["role"], True))
                    for i, line in enumerate(transcript_lines(row["role"], row["text"])):
                        state = begin if i == 0 else begin + 1
                        mark = marker_of(line)[0]
                        add("marker", state, ROLES.index(mark) if mark else len(ROLES))
                        add("shape", state, shape_of(line))
                        if last is None:
                            add("start", 0, state)
                        elif last >= 0:
                            add("step", last, state)
                        last = state
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.int32()),
             pa.array([k[2] for k in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["kind", "a", "b", "n"])

    sums = held.select("before", "rows").mapInArrow(run, "kind string, a int, b int, n long").groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))
    counts = {(r.kind, r.a, r.b): r.n for r in sums.collect()}
    for kind, a, b in _partition_borders(held):
        counts[kind, a, b] = counts.get((kind, a, b), 0) + 1
    return Hmm(counts)


def _partition_borders(held: DataFrame):
    """(kind, a, b) of the first lines of all partitions: starts, or steps from the partition before (a row each)."""
    def ends(batches):
        for batch in batches:
            out = [(c, p, k, _first_state(rows[0]), _last_state(rows[-1])) for c, p, k, rows in _each(batch)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(
                zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()), strict=True)],
                names=["conv", "part", "block", "first", "last"])

    sums = held.select("conv", "part", "block", "rows").mapInArrow(ends, "conv long, part int, block int, first int, last int").groupBy("part").agg(
        F.min(F.struct("block", "conv", "first")).alias("head"), F.max(F.struct("block", "conv", "last")).alias("tail"))
    before = None
    for r in sorted(sums.collect(), key=lambda r: r.part):
        goes_on = before is not None and before.conv == r.head.conv
        if r.head.first != _UNKNOWN and not goes_on:
            yield "start", 0, r.head.first
        elif r.head.first != _UNKNOWN and before.last != _UNKNOWN:
            yield "step", before.last, r.head.first
        before = r.tail


def _lines(rows) -> list[str]:
    return [line for row in rows for line in transcript_lines(row["role"], row["text"])]


def _matrix(values) -> np.ndarray:
    return np.array(values, dtype=float).reshape(len(STATES), len(STATES))


def format_chats(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, part, role, rendered): recovered turns in canonical form; ``turn`` is that of the first line."""
    held = staged(blocks(df, conv, turn, role, text), "chat-blocks")
    hmm = train(held)
    ends = held.groupBy("conv").agg(F.count("*").alias("n"), F.min(F.struct("part", "block")).alias("first"))
    d = held.join(ends.select(F.col("conv").alias("c"), "n", "first"), F.col("conv").eqNullSafe(F.col("c"))).drop("c")
    d = staged(d.select("conv", "part", "block", "rows", (F.col("n") == 1).alias("alone"),
                        (F.struct("part", "block") == F.col("first")).alias("opens")), "chat-parts")

    # Conversations of several blocks: matrices, two levels of products, borders.
    def matrices(batches):
        for batch in batches:
            conv, part, block, made = [], [], [], []
            for c, p, b, rows, opens in _each(batch):
                conv.append(c)
                part.append(p)
                block.append(b)
                made.append(hmm.transfer(_lines(rows), opens).ravel().tolist())
            yield pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(part, pa.int32()), pa.array(block, pa.int32()),
                                              pa.array(made, pa.list_(pa.float64()))], names=["conv", "part", "block", "m"])

    several = d.filter(~F.col("alone"))
    small = staged(several.select("conv", "part", "block", "rows", "opens").mapInArrow(
        matrices, "conv long, part int, block int, m array<double>"), "chat-matrices")

    def by_part(key, table):
        rows = sorted(table.to_pylist(), key=lambda r: r["block"])
        whole = list(itertools.accumulate((_matrix(r["m"]) for r in rows), product))[-1]
        return pa.table({"conv": pa.array([rows[0]["conv"]], pa.int64()), "part": pa.array([rows[0]["part"]], pa.int32()),
                         "m": pa.array([whole.ravel().tolist()], pa.list_(pa.float64()))})

    def by_conv(key, table):
        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        found = borders([_matrix(r["m"]) for r in rows], None, None)
        return pa.table({"conv": pa.array([r["conv"] for r in rows], pa.int64()), "part": pa.array([r["part"] for r in rows], pa.int32()),
                         "enter": pa.array([x for x, _ in found], pa.int32()), "leave": pa.array([y for _, y in found], pa.int32())})

    parts = small.groupBy("conv", "part").applyInArrow(by_part, "conv long, part int, m array<double>")
    outer = parts.groupBy("conv").applyInArrow(by_conv, "conv long, part int, enter int, leave int")
    o = outer.select(F.col("conv").alias("c"), F.col("part").alias("p"), "enter", "leave")
    within = small.join(o, F.col("conv").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))).drop("c", "p")

    def by_block(key, table):
        rows = sorted(table.to_pylist(), key=lambda r: r["block"])
        found = borders([_matrix(r["m"]) for r in rows], rows[0]["enter"], rows[0]["leave"])
        return pa.table({"conv": pa.array([r["conv"] for r in rows], pa.int64()), "part": pa.array([r["part"] for r in rows], pa.int32()),
                         "block": pa.array([r["block"] for r in rows], pa.int32()),
                         "enter": pa.array([x for x, _ in found], pa.int32()), "leave": pa.array([y for _, y in found], pa.int32())})

    inner = staged(within.groupBy("conv", "part").applyInArrow(by_block, "conv long, part int, block int, enter int, leave int"), "chat-borders")

    names = ["conv", "part", "block", "begins", "border", "turn", "role", "body"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.int64(), pa.string(), pa.string()]

    def trace(batches):
        for batch in batches:
            out = []
            for c, part, block, rows, enter, leave, alone in _each(batch):
                source = [row["turn"] for row in rows for _ in transcript_lines(row["role"], row["text"])]
                lines = _lines(rows)
                states = hmm.path(lines, enter, leave)
                turns: list = []
                for line, state, at in zip(lines, states, source, strict=True):
                    if not turns or STATES[state][1]:
                        turns.append((at, STATES[state], []))
                    turns[-1][2].append(marker_of(line)[1] if STATES[state][1] else line)
                for k, (at, (who, begins), held_lines) in enumerate(turns):
                    border = not begins or (not alone and k == len(turns) - 1)
                    out.append((c, part, block, begins, border, at, who, "\n".join(held_lines)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

    i = inner.select(F.col("part").alias("p"), F.col("block").alias("b"), "enter", "leave")
    no_state = F.lit(None).cast("int")
    columns = ["conv", "part", "block", "rows", "enter", "leave", "alone"]
    ready = d.filter("alone").withColumns({"enter": no_state, "leave": no_state}).select(columns).unionByName(
        several.join(i, (F.col("part") == F.col("p")) & (F.col("block") == F.col("b"))).select(columns))
    pieces = staged(ready.mapInArrow(
        trace, "conv long, part int, block int, begins boolean, border boolean, turn long, role string, body string"), "chat-pieces")

    # A turn that goes on over block borders: each of its pieces gets the block
    # of its head, the last one before with a line that begins a turn.
    cut = pieces.filter("border")
    heads = cut.select("conv", "part", "block", F.when(F.col("begins"), F.struct("part", "block")).alias("head"))
    heads = heads.groupBy("conv", "part", "block").agg(F.max("head").alias("head"))
    inside = Window.partitionBy("conv", "part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    over = heads.groupBy("conv", "part").agg(F.max("head").alias("head")).select(
        F.col("conv").alias("c"), F.col("part").alias("p"), F.max("head").over(earlier).alias("carried"))
    heads = heads.join(over, F.col("conv").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))).select(
        F.col("part").alias("p"), F.col("block").alias("b"), F.coalesce(F.max("head").over(inside), "carried").alias("before"))
    cut = cut.join(heads, (F.col("part") == F.col("p")) & (F.col("block") == F.col("b")))
    cut = cut.withColumn("head", F.when(F.col("begins"), F.struct("part", "block")).otherwise(F.col("before")))
    ordered = F.array_sort(F.collect_list(F.struct("part", "block", "conv", "turn", "role", "body")))
    joined = cut.groupBy("head").agg(ordered.alias("x")).select(
        F.col("x")[0]["conv"].alias("conv"), F.col("x")[0]["turn"].alias("turn"), F.col("x")[0]["role"].alias("role"),
        F.array_join(F.transform("x", lambda y: y["body"]), "\n").alias("body"))
    made = pieces.filter(~F.col("border")).select("conv", "turn", "role", "body").unionByName(joined)
    rendered = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("body"), F.lit("<|end|>"))
    return made.select(F.col("conv").alias(conv), F.col("turn").alias(turn), F.lit(0).alias("part"), "role", rendered.alias("rendered"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(read_table(spark, sf_dir, "conversations"))
