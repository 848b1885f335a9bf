"""Walking the groups of a sorted partition in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The runs of rows that agree in their first `keys` columns (integers without null), one table each.

    The input must be sorted by those columns. One group at a time is in memory, so the caller must have bounded it.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        change = np.zeros(len(batch) - 1, bool)
        for k in range(keys):
            v = batch.column(k).to_numpy(zero_copy_only=False)
            change |= v[1:] != v[:-1]
        cut = [0, *(np.flatnonzero(change) + 1).tolist(), len(batch)]
        for a, b in zip(cut, cut[1:]):
            key = tuple(batch.column(k)[a].as_py() for k in range(keys))
            if last is not None and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def column(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy()
