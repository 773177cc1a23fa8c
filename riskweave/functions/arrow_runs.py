"""Runs of equal keys in a sorted stream of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def key_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, pa.Table]]:
    """(key, rows) of each stretch of rows with an equal, non-null integer key; one stretch is held at a time."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(key).to_numpy(zero_copy_only=False)
        edges = [0, *(np.nonzero(values[1:] != values[:-1])[0] + 1).tolist(), len(values)]
        for a, b in zip(edges[:-1], edges[1:]):
            if values[a] != now:
                if held:
                    yield now, pa.Table.from_batches(held)
                now, held = values[a], []
            held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held)


def run_slices(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, bool, pa.RecordBatch]]:
    """(key, is_first, rows) of each stretch of rows with an equal, non-null integer key, slice by slice: nothing is held."""
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(key).to_numpy(zero_copy_only=False)
        edges = [0, *(np.nonzero(values[1:] != values[:-1])[0] + 1).tolist(), len(values)]
        for a, b in zip(edges[:-1], edges[1:]):
            yield values[a], values[a] != now, batch.slice(a, b - a)
            now = values[a]
