"""Streams of Arrow batches sorted by a key, cut into whole runs of equal keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that hold every run of ``key`` whole; only the run that a batch ends in is kept back."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(k, k[-1]))
        if held and cut == 0 and held[-1].column(key)[-1].as_py() == k[-1]:
            held.append(batch)
            continue
        if held and cut and held[-1].column(key)[-1].as_py() != k[0] or not held or cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
        else:
            yield pa.Table.from_batches(held)
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def run_lengths(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and length of every run of equal values."""
    if not len(k):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return begin, np.diff(np.append(begin, len(k)))
