"""Whole batches in Arrow streams: rows sorted by (batch_id, pos) within partitions, cut where the id changes.

One Python call sees many batches as one table and the bounds of each, so the cost of a call is shared;
a batch that goes on in the next Arrow batch is held back. Memory: TOGETHER and the largest batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T


#: Whole batches are handed on together up to about so many bytes.
TOGETHER = 32 << 20


def _changes(ids: pa.Array) -> np.ndarray:
    """Where another id begins; null is an id like any other."""
    a, b = ids[1:], ids[:-1]
    other = pc.fill_null(pc.not_equal(a, b), pc.xor(pc.is_null(a), pc.is_null(b)))
    return np.flatnonzero(other.to_numpy(zero_copy_only=False)) + 1


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole batches, and where each batch begins (and the last one ends)."""
    whole: list[pa.RecordBatch] = []
    open_: list[pa.RecordBatch] = []  # the batch that may go on
    size = 0
    for b in batches:
        if not len(b):
            continue
        ids = b.column(0)
        ends = _changes(ids)
        if open_ and open_[-1].column(0)[-1].as_py() != ids[0].as_py():
            whole, open_ = whole + open_, []
        if len(ends):
            whole, open_ = [*whole, *open_, b.slice(0, ends[-1])], [b.slice(ends[-1])]
        else:
            open_.append(b)
        size += b.nbytes
        if whole and size > TOGETHER:
            yield _cut(whole)
            whole, size = [], sum(x.nbytes for x in open_)
    if whole or open_:
        yield _cut(whole + open_)


def _cut(held: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
    table = pa.Table.from_batches(held).combine_chunks()
    ids = table.column(0).combine_chunks()
    return table, np.concatenate(([0], _changes(ids), [len(ids)]))


def per_batch(rows: DataFrame, make: Callable[[pa.Table, np.ndarray], dict[str, pa.Array]], fields: dict[str, T.DataType], dealt: bool = False) -> DataFrame:
    """(batch_id, *fields), a row for each batch: make gets a table of whole batches and their bounds.

    rows has batch_id, pos and what make needs. Batches are dealt by their id over the shuffle partitions,
    a batch to one task: its rows are folded in order, which nothing can split. Rows without a batch_id are a
    batch of their own. dealt says that the rows of
    each batch are in one partition already, as they are after the window that checks the order of keys.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in _chunks(batches):
            made = make(table, bounds)
            ids = table.column(0).combine_chunks().take(pa.array(bounds[:-1]))
            yield pa.RecordBatch.from_arrays([ids, *(made[n] for n in fields)], ["batch_id", *fields])

    rest = [c for c in rows.columns if c not in ("batch_id", "pos")]
    found = rows.select("batch_id", "pos", *rest)
    ordered = (found if dealt else found.repartition("batch_id")).sortWithinPartitions("batch_id", "pos")
    schema = T.StructType([rows.schema["batch_id"], *(T.StructField(n, k) for n, k in fields.items())])
    return ordered.mapInArrow(each, schema)
