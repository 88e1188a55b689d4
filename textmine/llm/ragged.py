"""Lists of different lengths as flat numpy arrays, for tasks that work on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20  # text that one step of a task holds as words


def row_slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(first row, end row) of runs of whole rows with about ``size`` bytes of text; one row at least."""
    if not len(texts):
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a, before = 0, 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield a, b
        a, before = b, int(ends[b - 1])


def distinct(pieces: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The different strings of a list, and for each entry its place among them."""
    coded = pa.array(pieces, pa.large_string()).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)


def offsets_of(lengths) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def gather(values: np.ndarray, offsets: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lists ``codes`` of the ragged (values, offsets), one after the other, and their offsets."""
    first = offsets[codes]
    lengths = offsets[codes + 1] - first
    ends = offsets_of(lengths)
    if len(codes) == ends[-1] and (lengths == 1).all():
        return values[first], ends
    return values[np.arange(ends[-1]) + np.repeat(first - ends[:-1], lengths)], ends


def list_array(values: np.ndarray, offsets: np.ndarray, valid: np.ndarray | None = None, kind=pa.int32()) -> pa.Array:
    """An Arrow list column; rows that are not ``valid`` are null."""
    mask = None if valid is None or valid.all() else pa.array(~valid)
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind), mask=mask)
