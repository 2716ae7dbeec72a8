"""Registered streaming queries: the streaming forms over the shared tables.

Each runs with `availableNow` into a table under the session's checkpoint folder
and returns that table. Some read their tables as file streams: the files hold
rows in no time order, so all of them form one micro-batch, in which no row is
late, and the batch that follows it runs with the watermark at the latest event
time and emits what that watermark closes. Others read a replay of the tables
in time order (`streaming.replay`) in `BATCHES` micro-batches, in which windows
and auctions close one after another. Windows and auctions still open at the end
are not results, which is what the oracles state.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from gavel.functions.time import event_time
from gavel.operators.latency import samples_from_events
from gavel.session import ensure_checkpoint_dir
from gavel.sources.events import to_events
from gavel.sources.tables import (
    TABLE_SCHEMAS, AuctionTables, auction_from_orders, bid_from_lineitem, bids_from_events, dense_bids, from_tpch,
    person_from_customer, read_table,
)
from gavel.streaming import queries as S
from gavel.streaming.blocks import rows_by_blocks
from gavel.streaming.closing import SALTS, closed_auctions_sessions, hot_auctions
from gavel.streaming.diff import diff_stream
from gavel.streaming.fanout import fan_out
from gavel.streaming.frames import means_sink
from gavel.streaming.late import dropped_rows, without_late
from gavel.streaming.latency import ccdf_so_far, ccdf_writer, latency_timeline_stream
from gavel.streaming.packs import blocks_of
from gavel.streaming.replay import STRIDE, write_replay
from gavel.streaming.sources import ROCKSDB, state_shards, state_store
from gavel.streaming.upserts import KeyedLog

# Longest auction of the adapter (expiry is 1 to 90 days after the start).
MAX_AUCTION_LENGTH = "90 days"

# Micro-batches of a replay, and of one whose batches run several jobs each.
BATCHES = 20
SHARED_BATCHES = 4

# Rows of a replay's file where a micro-batch is several files.
FILE_ROWS = 500_000

Q5_DENSE = ("1 hour", "10 minutes")


def read_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # As a pattern, the path may be a folder or a single file.
    return spark.readStream.schema(TABLE_SCHEMAS[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parque[t]")


def stream_tpch(spark: SparkSession, sf_dir: str) -> AuctionTables:
    return AuctionTables(person=person_from_customer(read_stream(spark, sf_dir, "customer")),
                         auction=auction_from_orders(read_stream(spark, sf_dir, "orders")),
                         bid=bid_from_lineitem(read_stream(spark, sf_dir, "lineitem")))


def timed(df: DataFrame, delay: str = "0 seconds") -> DataFrame:
    return df.withColumn("event_time", event_time("date_time_ns")).withWatermark("event_time", delay)


def fresh_folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{uuid.uuid4().hex}"


def replayed(df: DataFrame, time_col: str = "date_time_ns", batches: int = BATCHES, **how) -> DataFrame:
    """A table as a stream in time order."""
    spark = df.sparkSession
    return write_replay(df, f"{fresh_folder(spark)}/feed", time_col, batches, **how).stream(spark)


def rows_of(spark: SparkSession, sf: str, *names: str) -> int:
    """Rows of the shared tables, from the files' footers."""
    return sum(read_table(spark, sf, name).count() for name in names)


def finished(writer: DataStreamWriter, folder: str, provider: str = ROCKSDB, checkpoint: str = "checkpoint", rows: int | None = None) -> StreamingQuery:
    """Run a streaming query over all input that is there. With `rows`, the most that a micro-batch reads, its state is
    sharded for that many, and not counted."""
    spark = SparkSession.active()
    with state_store(spark, provider, None if rows is None else state_shards(spark, rows), counted=rows is None):
        query = writer.option("checkpointLocation", f"{folder}/{checkpoint}").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def into(df: DataFrame, folder: str) -> DataStreamWriter:
    return df.writeStream.format("parquet").option("path", f"{folder}/table").outputMode("append")


def run_to_table(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Run a streaming query over all input that is there, into shared storage; its result as a table."""
    folder = fresh_folder(df.sparkSession)
    finished(into(df, folder), folder, rows=rows)
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/table")


def auction_events(spark: SparkSession, sf: str) -> DataFrame:
    """Auctions and bids of the shared tables as one table of tagged events, with their time."""
    events = to_events(from_tpch(spark, sf)).where(F.col("type") != "Person")
    return events.withColumn("date_time_ns", F.coalesce("auction.date_time_ns", "bid.date_time_ns"))


def _closed_bounded(spark: SparkSession, sf: str) -> DataFrame:
    rows = _closing_rows(spark, sf)
    shards, hot = _hot(spark, sf, rows)
    return S.closed_auctions_stream_bounded(to_events(stream_tpch(spark, sf)), MAX_AUCTION_LENGTH, per_batch=rows, salts=max(SALTS, shards), hot=hot)


def _dense(spark: SparkSession, sf: str) -> DataFrame:
    return timed(bids_from_events(read_stream(spark, sf, "events")))


def _closing_rows(spark: SparkSession, sf: str, batches: int = 1) -> int:
    return -(-rows_of(spark, sf, "orders", "lineitem") // batches)


def _hot(spark: SparkSession, sf: str, rows: int) -> tuple[int, list[int]]:
    """Shards for closing by blocks, of micro-batches of `rows` rows, and the auctions that are hot for them."""
    shards = state_shards(spark, rows_by_blocks(rows))
    return shards, hot_auctions(bid_from_lineitem(read_table(spark, sf, "lineitem")), rows, shards)


def _closed(spark: SparkSession, sf: str, events: DataFrame, rows: int) -> DataFrame:
    """The closing of auctions that come in micro-batches of `rows` rows, hot ones over all shards."""
    shards, hot = _hot(spark, sf, rows)
    return closed_auctions_sessions(events, salts=max(SALTS, shards), hot=hot, per_batch=rows)


def _closed_of_tables(spark: SparkSession, sf: str) -> DataFrame:
    return _closed(spark, sf, to_events(stream_tpch(spark, sf)), _closing_rows(spark, sf))


def _closed_of_replay(spark: SparkSession, sf: str, batches: int) -> DataFrame:
    rows = _closing_rows(spark, sf, batches)
    # The feed holds the fields that closing reads.
    auction = F.struct(*[f"auction.{c}" for c in ("id", "reserve", "date_time_ns", "expires_ns", "seller", "category")])
    events = auction_events(spark, sf).select("type", auction.alias("auction"), "bid", "date_time_ns")
    return _closed(spark, sf, replayed(events, batches=batches, files_per_batch=max(1, -(-rows // FILE_ROWS))), rows)


def means(closed: DataFrame, sinks: dict[str, tuple[str, int | None]], rows: int | None = None) -> dict[str, DataFrame]:
    """Run one closing stream (by blocks, of `rows` rows a micro-batch) into several running means: name -> (key, last);
    their results by name."""
    spark = closed.sparkSession
    folder = fresh_folder(spark)
    made = {name: means_sink(spark, f"{folder}/{name}", f"{folder}/{name}-state", key, last) for name, (key, last) in sinks.items()}
    finished(fan_out(closed, made), folder, rows=None if rows is None else rows_by_blocks(rows))
    out = {}
    for name, (key, _) in sinks.items():
        schema = f"{key} long, auction long, expires_ns long, avg_price long, batch int"
        out[name] = spark.read.schema(schema).parquet(f"{folder}/{name}").drop("batch")
    return out


def q4_q6_shared(spark: SparkSession, sf: str) -> DataFrame:
    """Q4 and Q6 from one closing of the auctions, which come in time order in a few micro-batches."""
    closed = _closed_of_replay(spark, sf, SHARED_BATCHES)
    got = means(closed, {"q4": ("category", None), "q6": ("bidder", 10)}, _closing_rows(spark, sf, SHARED_BATCHES))
    rows = [df.select(F.lit(name).alias("query"), F.col(df.columns[0]).alias("key"), "auction", "expires_ns", "avg_price") for name, df in got.items()]
    return rows[0].unionByName(rows[1])


def q4_update(spark: SparkSession, sf: str) -> DataFrame:
    """Q4's latest mean per category: one query closes the auctions into a table, a second one reads its files as they
    come, in update mode into an upsert table. It takes as many files a micro-batch as the first one writes in one."""
    folder = fresh_folder(spark)
    rows = _closing_rows(spark, sf, SHARED_BATCHES)
    closed = _closed_of_replay(spark, sf, SHARED_BATCHES)
    finished(into(closed, folder), folder, rows=rows_by_blocks(rows))
    files = max(8, state_shards(spark, rows_by_blocks(rows)))
    again = spark.readStream.schema(closed.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/table")
    log = KeyedLog(spark, f"{folder}/q4", "category long, avg_price long", ["category"])
    # A category is a row of a task's partial sums, so its state is far less than its closings.
    finished(S.q4_category_avg_stream(again).writeStream.outputMode("update").foreachBatch(log.put), folder, checkpoint="second", rows=0)
    return log.table()


def q8_as_written(spark: SparkSession, sf: str) -> DataFrame:
    """Q8 as written, of all auctions in one micro-batch; a pack of them is a row of the state."""
    rows = rows_of(spark, sf, "orders")
    return run_to_table(S.q8_as_written_stream(timed(stream_tpch(spark, sf).auction), "12 hours", rows), blocks_of(rows))


def dense_replay(spark: SparkSession, sf: str, delay: str = "0 seconds", **how) -> DataFrame:
    return timed(replayed(dense_bids(spark, sf), **how), delay)


def _dense_rows(spark: SparkSession, sf: str, batches: int = BATCHES) -> int:
    return -(-rows_of(spark, sf, "events") // batches)


def diff_q5(spark: SparkSession, sf: str) -> DataFrame:
    """Q5 by window() against Q5 by panes, both live: equal, so the result is empty."""
    bids = dense_replay(spark, sf)
    return run_to_table(diff_stream(S.q5_stream(bids, *Q5_DENSE, timed=True), S.q5_stream_panes(bids, *Q5_DENSE, timed=True)), _dense_rows(spark, sf)).drop("event_time")


def diff_q7(spark: SparkSession, sf: str) -> DataFrame:
    """Q7 on raw against Q7 on converted prices, both live: every window differs."""
    bids = replayed(dense_bids(spark, sf))
    raw, converted = (S.q7_stream(timed(b), "1 hour", timed=True) for b in (bids, S.q1_currency(bids)))
    return run_to_table(diff_stream(raw, converted), _dense_rows(spark, sf)).drop("event_time")


def disorder_of(rows: int, batches: int = BATCHES) -> int:
    """Groups of a little over three micro-batches, without a common factor with the stride."""
    n = 3 * -(-rows // batches) + 1
    return n if n % STRIDE else n + 1


def late_rows(spark: SparkSession, sf: str, delay: str) -> DataFrame:
    """Q7 over bids that come in bounded disorder, and how many of them the delay was too short for (by Spark's metric)."""
    bids = dense_bids(spark, sf)
    n = bids.count()
    feed = timed(replayed(bids, disorder=disorder_of(n)), delay)
    kept = S.q7_stream(without_late(feed, ["date_time_ns"]), "1 hour")
    folder = fresh_folder(spark)
    query = finished(into(kept, folder), folder, rows=-(-n // BATCHES))
    table = spark.read.schema(kept.schema).parquet(f"{folder}/table")
    lost = spark.range(1).select(F.lit("dropped").alias("what"), F.lit(None).cast("long").alias("window_end_ns"), F.lit(dropped_rows(query)).cast("long").alias("value"))
    return table.select(F.lit("window").alias("what"), "window_end_ns", F.col("price").alias("value")).unionByName(lost)


def _samples(spark: SparkSession, sf: str) -> DataFrame:
    feed = replayed(samples_from_events(read_table(spark, sf, "events")), "t_ns")
    return feed.withColumn("event_time", event_time("t_ns")).withWatermark("event_time", "0 seconds")


def latency_ccdf_live(spark: SparkSession, sf: str) -> DataFrame:
    folder = fresh_folder(spark)
    writer, log = ccdf_writer(_samples(spark, sf), f"{folder}/histogram")
    finished(writer, folder, rows=_dense_rows(spark, sf))
    return ccdf_so_far(log)


STREAM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "q3_stream": lambda s, d: (lambda t: run_to_table(S.q3_stream(t.auction, t.person), rows_of(s, d, "customer", "orders")))(stream_tpch(s, d)),
    "q5_stream": lambda s, d: run_to_table(S.q5_stream_panes(_dense(s, d), "1 hour", "10 minutes"), _dense_rows(s, d, 1)),
    "q7_stream": lambda s, d: run_to_table(S.q7_stream(timed(replayed(dense_bids(s, d))), "1 hour"), _dense_rows(s, d)),
    "q8_stream": lambda s, d: (lambda t: run_to_table(
        S.q8_stream(timed(t.person), timed(t.auction), "30 days"), rows_of(s, d, "customer", "orders")))(stream_tpch(s, d)),
    "q8_as_written_stream": q8_as_written,
    "closed_auctions_stream": lambda s, d: run_to_table(_closed_of_replay(s, d, BATCHES), rows_by_blocks(_closing_rows(s, d, BATCHES))),
    "closed_auctions_table_stream": lambda s, d: run_to_table(_closed_of_tables(s, d), rows_by_blocks(_closing_rows(s, d))),
    "closed_auctions_bounded_stream": lambda s, d: run_to_table(_closed_bounded(s, d), rows_by_blocks(_closing_rows(s, d))).drop("event_time"),
    "q4_running_stream": lambda s, d: means(_closed_of_tables(s, d), {"q4": ("category", None)}, _closing_rows(s, d))["q4"],
    "q6_stream": lambda s, d: means(_closed_of_tables(s, d), {"q6": ("bidder", 10)}, _closing_rows(s, d))["q6"],
    "q4_q6_shared_stream": q4_q6_shared,
    "q4_update_stream": q4_update,
    "diff_q5_stream": diff_q5,
    "diff_q7_stream": diff_q7,
    "late_rows_stream": lambda s, d: late_rows(s, d, "1 hour"),
    "late_rows_none_stream": lambda s, d: late_rows(s, d, "8 days"),
    "latency_timeline_stream": lambda s, d: run_to_table(latency_timeline_stream(_samples(s, d), "1 hour"), _dense_rows(s, d)),
    "latency_ccdf_stream": latency_ccdf_live,
}

STREAM_INPUTS = {
    "q3_stream": ["customer", "orders"], "q5_stream": ["events"], "q7_stream": ["events"],
    "q8_stream": ["customer", "orders"], "q8_as_written_stream": ["orders"],
    "closed_auctions_stream": ["orders", "lineitem"], "closed_auctions_table_stream": ["orders", "lineitem"],
    "closed_auctions_bounded_stream": ["orders", "lineitem"],
    "q4_running_stream": ["orders", "lineitem"], "q6_stream": ["orders", "lineitem"],
    "q4_q6_shared_stream": ["orders", "lineitem"], "q4_update_stream": ["orders", "lineitem"],
    "diff_q5_stream": ["events"], "diff_q7_stream": ["events"], "late_rows_stream": ["events"],
    "late_rows_none_stream": ["events"], "latency_timeline_stream": ["events"], "latency_ccdf_stream": ["events"],
}
