"""Joins on streams whose state holds packs of rows instead of rows.

Every row and side of a stream-stream join costs a few look-ups and writes of the
state store, whatever the row's size. Where a micro-batch is large, its rows are
packed first: keys are hashed to blocks, a micro-batch's rows of one block become
one row of arrays, and the join meets blocks. A pair of packs is then searched for
the pairs of rows with equal keys, by plain expressions.

A pack goes back to the state store's reads as a whole, so packs pay where a
micro-batch brings many rows of each block, and not in many small micro-batches.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Workers get this module's code with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Rows of a micro-batch in one block, on average.
PACK = 32

# Rows of one pack at most; a block of more (a hot key) gives several packs.
LARGEST = 1024

# Rows that a task packs at once.
CHUNK = 1 << 19


def blocks_of(rows: int) -> int:
    """Blocks for micro-batches of `rows` rows."""
    return max(1, rows // PACK)


def _packs(rows: pa.Table, largest: int) -> pa.RecordBatch:
    """One row per block, of arrays; the first column is the block."""
    rows = rows.combine_chunks()
    block = rows.column(0).to_numpy()
    order = np.argsort(block, kind="stable")
    block, rows = block[order], rows.take(pa.array(order)).combine_chunks()
    first = np.concatenate(([True], block[1:] != block[:-1]))
    start = np.maximum.accumulate(np.where(first, np.arange(len(block)), 0))
    first |= (np.arange(len(block)) - start) % largest == 0
    starts = np.flatnonzero(first)
    offsets = pa.array(np.append(starts, len(block)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, c.combine_chunks()) for c in rows.columns[1:]]
    return pa.RecordBatch.from_arrays([pa.array(block[starts]), *lists], names=rows.column_names)


def packed(rows: DataFrame, key: str, blocks: int, per_batch: int, chunk: int = CHUNK, largest: int = LARGEST) -> DataFrame:
    """LONG columns, the key without nulls, as (block, an array of each column); `per_batch` rows come in a micro-batch."""
    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= chunk:
                yield _packs(pa.Table.from_batches(held), largest)
                held, n = [], 0
        if n:
            yield _packs(pa.Table.from_batches(held), largest)
    # Half a chunk a task, so that a block gives one pack.
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-2 * per_batch // chunk))
    schema = ", ".join(["block long", *(f"{c} array<long>" for c in rows.columns)])
    return (rows.select(F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block"), *rows.columns)
            .repartition(parts, "block").mapInArrow(run, schema))
