"""Latency samples from a running query's progress reports.

Each micro-batch gives one sample: its end time and its duration (trigger
execution), both in ns, ready for `operators.latency` (CCDF, timeline, trim),
and the events it took in. Spark retains only the last progress reports of a query
(`spark.sql.streaming.numRecentProgressUpdates`, 100 by default); a
`ProgressLog` polled during the run collects every batch, and samples that
would leave out a batch raise instead.
"""

from __future__ import annotations

import datetime as _dt
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

NS_PER_MS = 1_000_000


def _ns(ts: str) -> int:
    t = _dt.datetime.fromisoformat(ts.replace("Z", "+00:00"))
    return (int(t.timestamp()) * 1_000_000 + t.microsecond) * 1000


def events_fed(progress) -> int:
    """Events that a micro-batch took in, each once. `numInputRows` counts a source as often as the query reads it, so
    where a source has row numbers as offsets their difference counts instead."""
    total = 0
    for source in progress["sources"]:
        start, end = (_row_number(source[k]) for k in ("startOffset", "endOffset"))
        total += source["numInputRows"] if end is None else end - (start or 0)
    return total


def _row_number(offset) -> int | None:
    """The row number in an offset of the rate source, a text of {offset, timestamp}."""
    found = re.search(r"\boffset\W+(\d+)", str(offset)) if "timestamp" in str(offset) else None
    return int(found.group(1)) if found else None


class ProgressLog:
    """Every executed micro-batch of a query, by batch id. Poll it more often
    than the retained reports turn over."""

    def __init__(self, query: StreamingQuery, first_batch: int = 0):
        """`first_batch`: the batch that the run began with (not 0 when it resumed a checkpoint)."""
        self.query, self.first_batch = query, first_batch
        self.batches: dict[int, tuple[int, int, int]] = {}

    def poll(self) -> int:
        """Take in the retained reports; the number of batches so far."""
        for p in self.query.recentProgress:
            dur = p["durationMs"].get("triggerExecution")
            if dur is None or "addBatch" not in p["durationMs"]:
                continue  # an idle trigger executes nothing
            end = _ns(p["timestamp"]) + dur * NS_PER_MS
            self.batches[p["batchId"]] = (end, dur * NS_PER_MS, events_fed(p))
        return len(self.batches)

    def samples(self, spark: SparkSession, skip: int = 0) -> DataFrame:
        """(t_ns, latency_ns, rows) of every batch after the first `skip`."""
        self.poll()
        ids = sorted(self.batches)
        if ids and ids != list(range(self.first_batch, self.first_batch + len(ids))):
            raise RuntimeError("progress reports of earlier batches are gone; poll the log during the run")
        return spark.createDataFrame([self.batches[i] for i in ids[skip:]], "t_ns long, latency_ns long, rows long")


def progress_samples(spark: SparkSession, query: StreamingQuery) -> DataFrame:
    """Samples of all batches of a query; raises if some reports are gone."""
    return ProgressLog(query).samples(spark)
