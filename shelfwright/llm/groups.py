"""Groups of sorted Arrow batches, kept whole across batch ends."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_groups(
    batches: Iterator[pa.RecordBatch], keys: list[str], least_rows: int = 4096
) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, int]]]]:
    """Batches that end where a group ends, with the (start, end) rows of each group.

    The input is sorted by the keys, which are whole numbers without nulls. Memory is one batch and one group,
    so the caller bounds its groups.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < least_rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        edges = _edges(table, keys)
        if len(edges) > 2:
            last = edges[-2]
            yield table.slice(0, last), list(zip(edges[:-2], edges[1:-1], strict=True))
            held = [table.slice(last)]
        else:
            held = [table]
    if held:
        table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        edges = _edges(table, keys)
        yield table, list(zip(edges[:-1], edges[1:], strict=True))


def _edges(batch: pa.RecordBatch, keys: list[str]) -> list[int]:
    n = batch.num_rows
    new = np.zeros(n, dtype=bool)
    new[0] = True
    for key in keys:
        column = batch.column(key).to_numpy(zero_copy_only=False)
        new[1:] |= column[1:] != column[:-1]
    return [*np.flatnonzero(new).tolist(), n]
