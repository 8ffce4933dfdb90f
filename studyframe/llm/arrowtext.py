"""Reading text columns of Arrow batches inside tasks, a bounded number of bytes at a time."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: UTF-8 bytes handled at once; a longer text is handled alone.
SLICE_BYTES = 1 << 20


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=column.offset + n + 1)[column.offset:]
    if n == 0 or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - (offsets[0] if len(offsets) else 0)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, text_col: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts hold at most ``limit`` bytes (or one row)."""
    if batch.num_rows == 0:
        return
    _, offsets = text_bytes(batch.column(text_col))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def release() -> None:
    """Give the memory that a worker process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(mapper):
    """A mapper whose worker, used again by later stages, holds on to no freed memory after a task."""

    @functools.wraps(mapper)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from mapper(batches)
        finally:
            release()

    return run


def per_slice(make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], text_col: str, limit: int = SLICE_BYTES):
    """A mapInArrow function: ``make()`` runs once a task and gives the function for each slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, text_col, limit):
                out = work(part)
                if out.num_rows:
                    yield out

    return tidy(run)


def strings(column: pa.Array) -> list[str]:
    """Texts as Python strings; null is empty."""
    return [x or "" for x in column.to_pylist()]
