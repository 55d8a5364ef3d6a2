"""Memory of Python workers: Arrow batches cut by the size of their texts."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text that a worker handles at a time.
SLICE_BYTES = 4 << 20


def give_back() -> None:
    """Return freed memory of a worker to the system. Workers live through many stages, and
    what one stage has freed would otherwise count on top of the next one's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library: it keeps its own counsel


def text_slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about `most` bytes of text (one row at least), so
    that a worker's memory follows the slice and the longest text."""
    sizes = pc.binary_length(batch.column(column).cast(pa.binary())).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < len(sizes):
        base = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(at, to - at)
        at = to
    give_back()
