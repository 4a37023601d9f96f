"""Arrow helpers shared by the operators that read whole texts."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 12 << 20
SLICE_ROWS = (1 << 20) - 1

try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # not glibc
    _trim = None


def give_back() -> None:
    """Hand freed memory to the system, so that a worker's size follows the slice
    it works on and not the largest mix of slices so far."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of at most ``most`` bytes of ``column`` (a
    longer single row stays whole) and at most ``SLICE_ROWS`` rows, so that memory
    follows the slice and not the batch.  A column of numbers counts as the sizes."""
    values = batch.column(column)
    size = pc.fill_null(values if pa.types.is_integer(values.type) else pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
    end = np.cumsum(size, dtype=np.int64)
    begin = 0
    while begin < len(size):
        base = end[begin - 1] if begin else 0
        stop = min(begin + SLICE_ROWS, max(begin + 1, int(np.searchsorted(end, base + most, side="right"))))
        yield batch.slice(begin, stop - begin)
        begin = stop
        give_back()


def texts(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The text column as plain strings, null read as empty."""
    return pc.fill_null(batch.column(column).cast(pa.string()), "")


def repeat_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of every range, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    small = max(total, int(starts.max()) + int(lengths.max())) < 1 << 31
    kind = np.int32 if small else np.int64
    out = np.repeat((starts - (ends - lengths)).astype(kind), lengths)
    out += np.arange(total, dtype=kind)
    return out


def gather(flat: np.ndarray, offsets: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenation of lists ``picks`` out of (flat, offsets), with their lengths."""
    lengths = np.diff(offsets)[picks]
    return flat[repeat_ranges(offsets[picks], lengths)], lengths
