"""Late rows: dropped row by row, and counted by Spark itself.

A windowed aggregation drops a late row only with its whole window, and counts partial groups, not rows. Here rows
behind the watermark are dropped before any aggregation, by the one built-in operator that looks at single rows
(deduplication within the watermark), so its metric is the number of rows. Spark judges lateness by the
watermark of the micro-batch before: a row is late if its time is at or before the latest time seen two micro-batches
ago or earlier, less the delay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def without_late(stream: DataFrame, keys: list[str]) -> DataFrame:
    """A watermarked stream without its late rows. `keys` identify a row; rows that repeat within the delay come once."""
    return stream.dropDuplicatesWithinWatermark(keys)


def dropped_rows(query: StreamingQuery) -> int:
    """Rows that the stateful operators of a finished query dropped as late, by Spark's metric. Raises if some of the
    query's progress reports are gone (`spark.sql.streaming.numRecentProgressUpdates`)."""
    reports = {p["batchId"]: p for p in query.recentProgress if "addBatch" in p["durationMs"]}
    if sorted(reports) != list(range(len(reports))):
        raise RuntimeError("progress reports of earlier batches are gone")
    return sum(op["numRowsDroppedByWatermark"] for p in reports.values() for op in p["stateOperators"])
