"""Bounded, ordered event streams for stream = batch tests (local files)."""

from __future__ import annotations

import glob
import os
import tempfile

from pyspark.sql import functions as F

from gavel.schema import BID, EVENT
from gavel.streaming.sources import ROCKSDB, state_store

SENTINEL_AUCTION = -1


def fresh(prefix: str) -> str:
    return tempfile.mkdtemp(prefix=f"gavel-{prefix}-", dir="/tmp")


def write_ordered_event_files(spark, events, chunks: int, sentinel_after_ns: int) -> str:
    """Write events in arrival order, one parquet file per chunk, then two
    sentinel bids far in the future: the first moves the watermark past every
    window and timer, the second runs a batch with that watermark (a bounded
    availableNow run stops without a trailing no-data batch)."""
    folder, stage = fresh("feed"), fresh("stage")
    n = events.count()
    step = -(-n // chunks)
    def sentinel(t):
        # a bid and an auction: queries with a watermark per relation need both
        return spark.createDataFrame(
            [("Bid", None, None, (SENTINEL_AUCTION, 0, 0, t)),
             ("Auction", None, (SENTINEL_AUCTION, "", "", 0, 10**12, t, t + 1, 0, 0), None)], EVENT)
    parts = [events.where((F.col("arrival") >= i * step) & (F.col("arrival") < (i + 1) * step))
             for i in range(chunks)] + [sentinel_after_ns, sentinel_after_ns + 1]
    for i, part in enumerate(parts):
        df = sentinel(part) if isinstance(part, int) else \
            part.orderBy("arrival").select("type", "person", "auction", "bid")
        out = os.path.join(stage, f"c{i}")
        df.coalesce(1).write.parquet(out)
        (src,) = glob.glob(os.path.join(out, "part-*.parquet"))
        dst = os.path.join(folder, f"{i:05d}.parquet")
        os.rename(src, dst)
        os.utime(dst, (1_600_000_000 + i, 1_600_000_000 + i))
    return folder


def run_to_memory(df, name: str, mode: str = "append", provider: str = ROCKSDB):
    with state_store(df.sparkSession, provider):
        q = (df.writeStream.format("memory").queryName(name).outputMode(mode)
             .option("checkpointLocation", fresh("ckpt")).trigger(availableNow=True).start())
    q.awaitTermination()
    return df.sparkSession.table(name)


def run_to_folder(df, mode: str = "append") -> str:
    out = fresh("sink")
    with state_store(df.sparkSession, ROCKSDB):
        q = (df.writeStream.format("parquet").option("path", out).outputMode(mode)
             .option("checkpointLocation", fresh("ckpt")).trigger(availableNow=True).start())
    q.awaitTermination()
    return out


__all__ = ["BID", "write_ordered_event_files", "run_to_memory", "run_to_folder", "fresh"]
