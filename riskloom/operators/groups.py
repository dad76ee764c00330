"""Rows of many small groups that tasks take as streams: a group is whole, and starting one costs nothing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def dealt(rows: DataFrame, key: str, count: int, rows_a_task: int, *order: str) -> DataFrame:
    """Rows with those of a key in one task, next to each other and in the given order. count: how many rows there are."""
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-count // rows_a_task))
    return rows.repartition(tasks, key).sortWithinPartitions(key, *order)


def starts(column: pa.Array) -> np.ndarray:
    """The places at which another key begins, and the end."""
    if not len(column):
        return np.zeros(1, np.int64)
    other = pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.flatnonzero(other) + 1, [len(column)]]).astype(np.int64)


def whole(batches, key: str):
    """Batches of rows that lie by key, none of them null, cut between keys: each that is given has all rows of its keys."""
    held: list[pa.RecordBatch] = []
    name = lambda batch, k: batch.column(key)[k].as_py()

    def joined() -> pa.RecordBatch:
        return pa.concat_batches(held) if len(held) > 1 else held[0]

    for batch in batches:
        if not len(batch):
            continue
        cut = int(starts(batch.column(key))[-2])
        if held and (cut or name(held[0], 0) != name(batch, 0)):
            if cut:
                held.append(batch.slice(0, cut))
            yield joined()
            held = []
        elif cut:
            yield batch.slice(0, cut)
        held.append(batch.slice(cut))
    if held:
        yield joined()
