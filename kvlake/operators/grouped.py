"""Arrow streams cut at group boundaries, for the few folds that no built-in operator expresses."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows that come sorted by `keys`, in tables that never split a group."""
    held: list[pa.RecordBatch] = []

    def column(b: pa.RecordBatch, k: str) -> pa.Array:
        return b.column(b.schema.get_field_index(k))

    def tail_start(b: pa.RecordBatch) -> int:
        differs = np.zeros(b.num_rows, bool)
        for k in keys:
            c = column(b, k).to_numpy(zero_copy_only=False)
            differs |= c != c[-1]
        at = np.flatnonzero(differs)
        return int(at[-1]) + 1 if at.size else 0

    def same(a: pa.RecordBatch, b: pa.RecordBatch) -> bool:
        return all(column(a, k)[-1] == column(b, k)[0] for k in keys)

    for b in batches:
        if not b.num_rows:
            continue
        if held and not same(held[-1], b):
            yield pa.Table.from_batches(held)
            held = []
        cut = tail_start(b)
        if cut:
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held = []
        held.append(b.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def group_bounds(*keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys, and the end."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.append(np.flatnonzero(new), n)
