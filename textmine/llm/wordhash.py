"""Vectorised word splitting and hashing of Arrow text columns.

Words are the maximal runs of bytes other than the six ASCII white-space
characters (0x20, 0x09-0x0D), the word rule of every operator here that
works on word sequences.  All functions take one Arrow array and work on
slices of about ``slice_bytes`` of text, so memory follows the slice (and the
longest single document), not the batch.  A null text is an empty text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

# For comparisons beyond case and punctuation: words of letters, digits and
# non-ASCII bytes, with A-Z as a-z.
PUNCTUATION = np.array([not (chr(b).isalnum() or b >= 0x80) for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

# Odd multipliers for the polynomial hash of a word's bytes; the second one
# serves hashes of word windows and of shingles.
BYTE_BASE = 0x9E3779B97F4A7C15
WINDOW_BASE = 0xD1342543DE82EF95
_MASK = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base & _MASK, dtype=np.uint64)
    if n:
        out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


_POWER_CACHE: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """Cached powers of ``base``; the longest array asked for is kept."""
    have = _POWER_CACHE.get(base)
    if have is None or len(have) < n:
        have = _POWER_CACHE[base] = _powers(base, max(n, 1 << 16))
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _word_bounds(data: np.ndarray, doc_starts: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every word of ``data``; documents do not join."""
    inside = ~between[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at = doc_starts[doc_starts < len(data)]
    first[at] = inside[at]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    before = at[at > 0] - 1
    last[before] = inside[before]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _hash_spans(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of each data[start:stop]: sum (byte+1) * B**(stop-1-i), mixed with its length."""
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    # Horner form by columns: as many steps as the longest word, each only
    # over the words that still have a byte.
    with np.errstate(over="ignore"):
        h = np.zeros(len(start), dtype=np.uint64)
        length = stop - start
        order = np.argsort(-length, kind="stable")
        longest = -np.sort(-length)
        base = np.uint64(BYTE_BASE)
        pos, acc = start[order], h
        step = 0
        alive = len(start)
        while True:
            alive = int(np.searchsorted(-longest, -step, side="left"))
            if not alive or step >= 64:
                break
            acc[:alive] = acc[:alive] * base + (data[pos[:alive] + step].astype(np.uint64) + np.uint64(1))
            step += 1
        for i in range(alive):  # the few words of over 64 bytes, by prefix sums
            a, n = int(pos[i]), int(longest[i])
            w = data[a:a + n].astype(np.uint64) + np.uint64(1)
            acc[i] = (w * powers(BYTE_BASE, n)[::-1]).sum(dtype=np.uint64)
        out = np.empty_like(acc)
        out[order] = mix(acc ^ (longest.astype(np.uint64) << np.uint64(48)))
    return out


def text_slices(col: pa.Array, slice_bytes: int = 1 << 20):
    """Yield (first row, end row, bytes, row offsets) over runs of whole rows."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_binary()), b"")
    n = len(col)
    if not n:
        return
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset:col.offset + n + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, dtype=np.uint8)
    a = 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + slice_bytes, side="right")) - 1
        b = min(max(b, a + 1), n)
        lo = int(offsets[a])
        yield a, b, data[lo:int(offsets[b])], offsets[a:b + 1] - lo
        a = b


def word_hashes(data: np.ndarray, row_offsets: np.ndarray, between: np.ndarray = _WHITE):
    """(hash per word, first word index per row + end, word starts, word stops).

    ``between`` marks the bytes that stand between words.
    """
    start, stop = _word_bounds(data, row_offsets[:-1], between)
    bounds = np.searchsorted(start, row_offsets)
    return _hash_spans(data, start, stop), bounds, start, stop


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive words (empty when too few)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    # Doubling: hashes of runs of 1, 2, 4, ... words are combined for any size.
    with np.errstate(over="ignore"):
        acc, acc_len = None, 0
        run, run_len, left = words, 1, size
        while left:
            if left & 1:
                if acc is None:
                    acc, acc_len = run, run_len
                else:
                    m = min(len(acc), len(run) - acc_len)
                    acc = acc[:m] * np.uint64(pow(WINDOW_BASE, run_len, 1 << 64)) + run[acc_len:acc_len + m]
                    acc_len += run_len
            left >>= 1
            if left:
                m = len(run) - run_len
                run = run[:m] * np.uint64(pow(WINDOW_BASE, run_len, 1 << 64)) + run[run_len:run_len + m]
                run_len *= 2
        return mix(acc[:n])


def sliding_min_positions(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost minimum of each run of ``width`` values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    pos = np.arange(len(values))
    val, best, have = values, pos, 1
    # Windows of 1, 2, 4, ... values; two overlapping ones cover ``width``.
    while have * 2 <= width:
        m = len(val) - have
        right = val[have:] < val[:m]
        best = np.where(right, best[have:], best[:m])
        val = np.where(right, val[have:], val[:m])
        have *= 2
    shift = width - have
    right = val[shift:shift + n] < val[:n]
    return np.where(right, best[shift:shift + n], best[:n])
