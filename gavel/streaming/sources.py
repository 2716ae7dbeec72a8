"""Streaming inputs: the generated event feed and file-based event streams.

Every stream carries `event_time` (TIMESTAMP, µs) beside the exact LONG ns
times, with a watermark whose delay covers the feed's disorder.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavel.functions.time import event_time
from gavel.schema import EVENT
from gavel.sources.generator import GeneratorConfig, events_from_numbers, tables_from_numbers
from gavel.sources.tables import AuctionTables

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Rows of a micro-batch that are worth a state shard of their own.
SHARD_ROWS = 100_000


def state_shards(spark: SparkSession, rows: int) -> int:
    """Shards of each stateful operator for micro-batches of `rows` rows: one a core, as many again as the rows grow, at
    most the session's shuffle partitions. A commit writes files for every shard, however few rows it holds."""
    most, cores = int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism
    return min(most, max(1, -(-rows // (SHARD_ROWS * cores))) * cores)


@contextlib.contextmanager
def state_store(spark: SparkSession, provider: str | None = ROCKSDB, shards: int | None = None, counted: bool = True) -> Iterator[None]:
    """The state store of the queries started inside, and the session's own
    settings again afterwards (a query keeps the settings it started with).

    Keyed processors (transformWithState) require RocksDB. Changelog
    checkpointing commits only the changes of a micro-batch (snapshots are
    taken in the background). `shards` is the number of shards of each stateful
    operator (else the session's shuffle partitions); without `counted` RocksDB
    doesn't look each key up again to report how many rows it holds.
    """
    wanted = {} if provider is None else {"spark.sql.streaming.stateStore.providerClass": provider}
    if provider == ROCKSDB:
        wanted["spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"] = "true"
        wanted["spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows"] = str(counted).lower()
    if shards is not None:
        wanted["spark.sql.shuffle.partitions"] = str(shards)
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def generated_event_stream(spark: SparkSession, rows_per_batch: int, cfg: GeneratorConfig = GeneratorConfig(),
                           num_partitions: int | None = None) -> DataFrame:
    """Open-loop feed: `rate-micro-batch` numbers -> events (deterministic per number)."""
    reader = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", rows_per_batch)
    if num_partitions:
        reader = reader.option("numPartitions", num_partitions)
    return events_from_numbers(reader.load(), "value", cfg)


def generated_table_stream(spark: SparkSession, rows_per_batch: int, cfg: GeneratorConfig = GeneratorConfig(),
                           delay: str = "0 seconds") -> AuctionTables:
    """The same feed as three watermarked relations with flat columns."""
    numbers = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", rows_per_batch).load()
    t = tables_from_numbers(numbers, "value", cfg)
    return AuctionTables(*(df.withColumn("event_time", event_time("date_time_ns")).withWatermark("event_time", delay)
                           for df in (t.person, t.auction, t.bid)))


def event_file_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Tagged events from parquet files (schema fixed, no inference)."""
    reader = spark.readStream.schema(EVENT).format("parquet")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def timed_events(events: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """Tagged events with `event_time` (from the event's own time) and one watermark."""
    ns = F.coalesce("person.date_time_ns", "auction.date_time_ns", "bid.date_time_ns")
    return (events.select("type", "person", "auction", "bid")
            .withColumn("event_time", event_time(ns)).withWatermark("event_time", delay))


def timed_tables(events: DataFrame) -> AuctionTables:
    """Demux a watermarked event stream; every relation keeps `event_time`."""
    def part(kind: str, struct: str) -> DataFrame:
        return events.where(F.col("type") == kind).select(f"{struct}.*", "event_time")
    return AuctionTables(part("Person", "person"), part("Auction", "auction"), part("Bid", "bid"))


__all__ = ["state_store", "state_shards", "generated_event_stream", "generated_table_stream", "event_file_stream", "timed_events", "timed_tables"]
