"""Streams of sorted Arrow batches, cut where a key changes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_keys(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Join batches that are sorted by ``keys`` (integers, not null) to tables that hold whole groups only."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        new = np.zeros(len(table), dtype=bool)
        for k in keys:
            values = table.column(k).to_numpy()
            new[1:] |= values[1:] != values[:-1]
            if held:
                new[0] |= held[-1].column(k)[-1].as_py() != values[0]
        at = np.flatnonzero(new)
        cut = int(at[-1]) if len(at) else None
        if cut is None:
            held.append(table)
            continue
        held.append(table.slice(0, cut))
        whole = pa.concat_tables(held)
        held = [table.slice(cut)]
        if len(whole):
            yield whole
    if held:
        yield pa.concat_tables(held)


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where each group of a sorted table starts, and the table's length."""
    new = np.ones(len(table), dtype=bool)
    if len(table):
        new[1:] = False
        for k in keys:
            values = table.column(k).to_numpy()
            new[1:] |= values[1:] != values[:-1]
    return np.append(np.flatnonzero(new), len(table))
