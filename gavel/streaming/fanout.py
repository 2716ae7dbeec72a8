"""One streaming query feeding several sinks: each micro-batch is read, and closed auctions are found, once.

A sink is a function of (micro-batch, batch id) that leaves the same result when a batch runs again: it writes under the
batch id with overwrite, or into a `KeyedLog`. If one of them fails, the whole batch runs again for all. The micro-batch
is kept on the executors while its sinks run; what is lost with an executor is computed again from the batch.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

Sink = Callable[[DataFrame, int], None]


def fan_out(stream: DataFrame, sinks: Mapping[str, Sink]) -> DataStreamWriter:
    """A writer that hands every micro-batch to all sinks, in their order."""
    if not sinks:
        raise ValueError("a fan-out needs a sink")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            batch.count()  # all partitions at once: a sink's first look (isEmpty) would work through them a few at a time
            for sink in sinks.values():
                sink(batch, batch_id)
        finally:
            batch.unpersist()
    return stream.writeStream.foreachBatch(write)


def table_sink(folder: str, rows: Callable[[DataFrame], DataFrame] = lambda batch: batch) -> Sink:
    """Writes `rows` of each micro-batch into a folder of its own below `folder` (a table with a `batch` column)."""
    def write(batch: DataFrame, batch_id: int) -> None:
        rows(batch).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/batch={batch_id}")
    return write
