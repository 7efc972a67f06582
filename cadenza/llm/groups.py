"""Helpers for Arrow batches that are sorted by a key: whole groups at a time, and local components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of complete groups, and where each group begins. Rows must come sorted by the integer ``keys``; a group is held whole."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        table = pa.Table.from_batches(held)
        begins = _begins(table, keys)
        if len(begins) > 1:
            yield table.slice(0, begins[-1]), begins[:-1]
            held = table.slice(begins[-1]).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield table, _begins(table, keys)


def _begins(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for k in keys:
        x = table.column(k).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Join the components of the pairs (i, j) in ``label``, where every node's label is its component's smallest."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := label[label], label):
            label = up
