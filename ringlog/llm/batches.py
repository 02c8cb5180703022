"""Record batches cut to a bounded amount of text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a task works on at once. A single longer text is worked on alone.
SLICE_BYTES = 4_000_000


def slices(
    batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """The batches again, each cut so that it holds at most `limit` bytes in the column."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(
            zero_copy_only=False
        )
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def lists(values: np.ndarray | pa.Array, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from all values one after another and the length of each list."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    if not isinstance(values, pa.Array):
        values = pa.array(values, type=kind)
    return pa.ListArray.from_arrays(pa.array(offsets), values)
