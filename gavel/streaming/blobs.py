"""Rows handed on as compressed Arrow blobs instead of one by one.

A row of a shuffle or of a state store costs far more than its few numbers: the row's own frame, a look-up, a write.
Here a task cuts its rows by a small number (a file's, a block of keys'), and all its rows of one number become one
compressed blob. A shuffle of blobs moves about what a columnar file holds.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# Workers get this module's code with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Rows that a task cuts at once.
CHUNK = 1 << 19

# Rows that a task returns at once.
PIECE = 1 << 16


def encoded(rows: pa.Table | pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write(rows)
    return sink.getvalue().to_pybytes()


def decoded(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(blob)).read_all()


def numbers(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a LONG column, 0 for nulls, and which are null."""
    return column.fill_null(0).to_numpy().astype(np.int64, copy=False), column.is_null().to_numpy()


def longs(values: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    return pa.array(values, pa.int64(), mask=null)


def chunks(batches: Iterator[pa.RecordBatch], most: int = CHUNK) -> Iterator[pa.Table]:
    """The batches of a task in tables of about `most` rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= most:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def cut(rows: pa.Table, to: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(number, blob) for the rows of each number in `to`."""
    order = np.argsort(to.astype(np.int16) if len(to) and to.max() < 1 << 15 else to, kind="stable")
    to, rows = to[order], rows.take(pa.array(order)).combine_chunks()
    starts = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1]))) if len(to) else []
    for a, b in zip(starts, [*starts[1:], len(to)]):
        yield int(to[a]), encoded(rows.slice(a, b - a))


def pieces(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    yield from rows.combine_chunks().to_batches(max_chunksize=PIECE)
