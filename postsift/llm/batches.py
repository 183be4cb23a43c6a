"""Arrow batches of bounded size, for the Python side of the operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BATCH_BYTES = 4 << 20


def bounded_batches(batches: Iterator[pa.RecordBatch], column: int = 1, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order, in slices of about ``limit`` bytes of ``column``; no row is cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = (np.cumsum(sizes, dtype=np.int64) - sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            yield batch.slice(lo, hi - lo)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of rows with equal ``keys`` in a sorted stream."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        cols = [table.column(k).to_numpy() for k in keys]
        changes = np.zeros(table.num_rows - 1, bool)
        for c in cols:
            changes |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(changes) + 1).tolist()]
        for lo, hi in zip(cuts, cuts[1:]):
            yield table.slice(lo, hi - lo)
        rest = table.slice(cuts[-1])
    if rest is not None:
        yield rest
