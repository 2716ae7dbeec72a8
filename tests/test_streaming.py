"""Streaming forms give the batch results on a bounded, ordered feed."""

import pytest
from oracle_util import _norm
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from stream_util import SENTINEL_AUCTION, run_to_folder, run_to_memory, write_ordered_event_files

from gavel.functions.time import NS_PER_SECOND
from gavel.operators.averages import q4_category_avg, q4_running_avg, q6_last_avg
from gavel.operators.basic import q1_currency, q2_selection
from gavel.operators.closing import closed_auctions
from gavel.operators.diff import diff_by_time
from gavel.operators.joins import q3_local_items, q8_as_written, q8_new_users
from gavel.operators.windows import q5_hot_items, q7_highest_bid
from gavel.schema import CLOSED
from gavel.sources.events import demux
from gavel.sources.generator import GeneratorConfig, generate_events
from gavel.streaming import queries as S
from gavel.streaming.sources import event_file_stream, timed_events, timed_tables

N = 12_000  # 12 s of events at 1,000/s
BASE = 1_700_000_000 * NS_PER_SECOND  # event time 0 would sit on Spark's initial watermark
CFG = GeneratorConfig(base_time_ns=BASE)
FAR = BASE + 10**6 * NS_PER_SECOND


def same(a, b):
    pa, pb = _norm(a.toPandas()), _norm(b.toPandas())
    return pa.equals(pb), (len(pa), len(pb))


@pytest.fixture(scope="module")
def feed(spark):
    events = generate_events(spark, N, CFG)
    folder = write_ordered_event_files(spark, events, chunks=6, sentinel_after_ns=FAR)
    return events, folder


def stream_tables(spark, folder, delay="0 seconds"):
    return timed_tables(timed_events(event_file_stream(spark, folder, max_files_per_trigger=1), delay))


def test_stateless_and_join_streams(spark, feed):
    events, folder = feed
    b = demux(events)
    t = stream_tables(spark, folder)
    bids = t.bid.where(F.col("auction") != SENTINEL_AUCTION)
    ok, n = same(run_to_memory(q1_currency(bids), "s_q1"), q1_currency(b.bid))
    assert ok, n
    ok, n = same(run_to_memory(q2_selection(bids), "s_q2"), q2_selection(b.bid))
    assert ok, n
    t = stream_tables(spark, folder)
    ok, n = same(run_to_memory(S.q3_stream(t.auction, t.person), "s_q3"), q3_local_items(b.auction, b.person))
    assert ok and n[0] > 0, n
    t = stream_tables(spark, folder)
    ok, n = same(run_to_memory(S.q8_stream(t.person, t.auction, "2 seconds"), "s_q8"),
                 q8_new_users(b.person, b.auction, "2 seconds"))
    assert ok and n[0] > 0, n
    t = stream_tables(spark, folder)
    got = run_to_memory(S.q8_as_written_stream(t.auction, "2 seconds"), "s_q8w").where(F.col("id") != SENTINEL_AUCTION)
    ok, n = same(got, q8_as_written(b.auction, "2 seconds"))
    assert ok and n[0] > 0, n


def test_window_streams(spark, feed):
    # The sentinel must reach the watermark, so results (not inputs) are filtered.
    events, folder = feed
    b = demux(events)
    t = stream_tables(spark, folder)
    got = run_to_memory(S.q7_stream(t.bid, "1 second"), "s_q7").where(F.col("window_end_ns") < FAR)
    ok, n = same(got, q7_highest_bid(b.bid, "1 second"))
    assert ok and n[0] == 12, n
    # the same check with the library's own stream-equality operator
    assert diff_by_time(got, q7_highest_bid(b.bid, "1 second"), "window_end_ns").count() == 0
    t = stream_tables(spark, folder)
    got = run_to_memory(S.q5_stream(t.bid, "4 seconds", "1 second"), "s_q5").where(F.col("window_end_ns") < FAR)
    ok, n = same(got, q5_hot_items(b.bid, "4 seconds", "1 second"))
    assert ok and n[0] > 0, n
    t = stream_tables(spark, folder)
    got = run_to_memory(S.q5_stream_panes(t.bid, "4 seconds", "1 second"), "s_q5p").where(F.col("window_end_ns") < FAR)
    ok, n = same(got, q5_hot_items(b.bid, "4 seconds", "1 second"))
    assert ok and n[0] > 0, n


def closed_stream(spark, folder, delay="0 seconds"):
    t = stream_tables(spark, folder, delay)
    return S.closed_auctions_stream(t.auction, t.bid)


def test_closed_auctions_stream_equals_batch(spark, feed):
    events, folder = feed
    b = demux(events)
    got = run_to_memory(closed_stream(spark, folder), "s_closed").drop("event_time")
    got = got.where(F.col("auction") != SENTINEL_AUCTION)
    ok, n = same(got, closed_auctions(b.auction, b.bid))
    assert ok and n[0] > 100, n


def test_bounded_builtin_closing_equals_batch(spark, feed):
    from gavel.sources.generator import max_auction_length_ns
    events, folder = feed
    b = demux(events)
    closed = S.closed_auctions_stream_bounded(event_file_stream(spark, folder, 1), max_auction_length_ns(CFG))
    got = run_to_memory(closed, "s_closed_b").where(F.col("auction") != SENTINEL_AUCTION).drop("event_time")
    ok, n = same(got, closed_auctions(b.auction, b.bid))
    assert ok and n[0] > 100, n


def test_bounded_closing_chains_into_running_mean(spark, feed):
    from gavel.sources.generator import max_auction_length_ns
    events, folder = feed
    b = demux(events)
    closed = S.closed_auctions_stream_bounded(event_file_stream(spark, folder, 1), max_auction_length_ns(CFG))
    # no filter on the sentinel here: Catalyst would push it below the watermark
    # (the sentinel auction never closes: its reserve is out of reach)
    got = run_to_memory(S.q4_running_stream(closed), "s_b_q4r")
    ok, n = same(got, q4_running_avg(closed_auctions(b.auction, b.bid)))
    assert ok and n[0] > 100, n


def test_closing_with_disorder(spark):
    cfg = GeneratorConfig(out_of_order_group_size=10, base_time_ns=BASE)
    events = generate_events(spark, N, cfg)
    folder = write_ordered_event_files(spark, events, chunks=6, sentinel_after_ns=FAR)
    b = demux(events)
    got = run_to_memory(closed_stream(spark, folder, "20 milliseconds"), "s_closed_dis").drop("event_time")
    ok, n = same(got, closed_auctions(b.auction, b.bid))
    assert ok and n[0] > 100, n


def test_means_in_one_query(spark, feed):
    """Closing and the per-closing means chained inside one streaming query."""
    events, folder = feed
    b = demux(events)
    closed_batch = closed_auctions(b.auction, b.bid)
    ok, n = same(run_to_memory(S.q4_running_stream(closed_stream(spark, folder)), "s1_q4r"),
                 q4_running_avg(closed_batch))
    assert ok and n[0] > 100, n
    ok, n = same(run_to_memory(S.q6_stream(closed_stream(spark, folder), "seller"), "s1_q6"),
                 q6_last_avg(closed_batch, "seller"))
    assert ok and n[0] > 100, n


def test_named_queries(spark, feed):
    from gavel.streaming.named import NAMES, start_named
    from stream_util import fresh
    events, folder = feed
    assert len(NAMES) == 35
    counts = {}
    for name in ["q2", "q3_rocksdb", "q4_faster", "q5_faster_in_mem", "q6_mem", "q7", "q8_rocksdb"]:
        out = fresh("named")
        q = start_named(spark, name, event_file_stream(spark, folder, max_files_per_trigger=1), out,
                        checkpoint=fresh("nckpt"), available_now=True)
        q.awaitTermination()
        counts[name] = spark.read.parquet(out).count()
    b = demux(events)
    assert counts["q2"] == b.bid.where("auction % 123 = 0").count()
    assert counts["q4_faster"] == counts["q6_mem"] == closed_auctions(b.auction, b.bid).count()
    assert all(v > 0 for v in counts.values()), counts


@pytest.mark.parametrize("key, last", [("category", None), ("bidder", 10), ("seller", 1), ("seller", 3)])
def test_running_means_by_micro_batch(spark, feed, key, last):
    from gavel.sources.generator import max_auction_length_ns
    from gavel.streaming.frames import running_means
    from gavel.streaming.sources import state_store
    from stream_util import fresh
    events, folder = feed
    b = demux(events)
    batch = closed_auctions(b.auction, b.bid)
    closed = S.closed_auctions_stream_bounded(event_file_stream(spark, folder, 1), max_auction_length_ns(CFG))
    out = fresh("means")
    with state_store(spark):
        q = (running_means(closed, out + "/table", out + "/state", key, last).trigger(availableNow=True)
             .option("checkpointLocation", out + "/checkpoint").start())
    q.awaitTermination()
    want = q4_running_avg(batch) if last is None else q6_last_avg(batch, key, last)
    ok, n = same(spark.read.parquet(out + "/table").drop("batch"), want)
    assert ok and n[0] > 100, n


def test_an_auction_over_the_bound_fails(spark, feed):
    """A bound that is too short fails the query; it loses no auction."""
    _, folder = feed
    closed = S.closed_auctions_stream_bounded(event_file_stream(spark, folder, 1), "200 milliseconds")
    with pytest.raises(StreamingQueryException, match="longer than max_length"):
        run_to_memory(closed, "s_closed_short")


def test_each_sink_has_its_own_checkpoint(spark, feed):
    from gavel.streaming.named import start_named
    from stream_util import fresh
    events, folder = feed
    want = demux(events).bid.where("auction % 123 = 0").count()
    for _ in range(2):
        out = fresh("sink2")
        start_named(spark, "q2", event_file_stream(spark, folder), out, available_now=True).awaitTermination()
        assert spark.read.parquet(out).count() == want > 0


def test_all_batches_are_sampled(spark):
    """More micro-batches than Spark retains: a polled log has them all, a late look raises."""
    import time
    from gavel.streaming.progress import ProgressLog, progress_samples
    from gavel.streaming.sources import generated_event_stream
    from stream_util import fresh
    key = "spark.sql.streaming.numRecentProgressUpdates"
    spark.conf.set(key, "5")
    try:
        q = (generated_event_stream(spark, 10, CFG).writeStream.format("noop")
             .option("checkpointLocation", fresh("many")).trigger(processingTime="50 milliseconds").start())
        log = ProgressLog(q)
        deadline = time.time() + 120
        while log.poll() < 12 and time.time() < deadline:
            time.sleep(0.02)
        with pytest.raises(RuntimeError, match="gone"):
            progress_samples(spark, q)
        q.stop()
        rows = log.samples(spark).collect()
        assert len(rows) >= 12 and all(r.rows == 10 for r in rows)
    finally:
        spark.conf.unset(key)


def write_feed(spark, batches):
    """One file of tagged bids (auction, price, t) or events for each micro-batch."""
    import glob
    import os
    from gavel.schema import EVENT
    from stream_util import fresh
    folder, stage = fresh("feed"), fresh("stage")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, EVENT).coalesce(1).write.parquet(f"{stage}/{i}")
        (src,) = glob.glob(f"{stage}/{i}/part-*.parquet")
        os.link(src, f"{folder}/{i:05d}.parquet")
        os.utime(f"{folder}/{i:05d}.parquet", (1_600_000_000 + i, 1_600_000_000 + i))
    return folder


def bid_event(auction, price, t):
    return ("Bid", None, None, (auction, 1, price, BASE + t * NS_PER_SECOND))


def auction_event(id_, t, expires, reserve=0):
    return ("Auction", None, (id_, "", "", 0, reserve, BASE + t * NS_PER_SECOND, BASE + expires * NS_PER_SECOND, 5, 10), None)


def test_a_row_behind_the_watermark_is_dropped(spark):
    """A bid behind the watermark of the micro-batch before is left out of its closed window (Spark judges
    lateness by that one); a bid within the delay counts."""
    folder = write_feed(spark, [
        [bid_event(1, 10, 1)], [bid_event(1, 20, 30)], [bid_event(1, 15, 31)],
        [bid_event(1, 99, 2)],  # its window [0 s, 10 s) closed when the watermark reached 25 s
        [bid_event(1, 50, 27)],  # behind the latest event, within the delay of 5 s
        [bid_event(1, 1, 1000)], [bid_event(1, 1, 1001)]])
    t = stream_tables(spark, folder, "5 seconds")
    got = run_to_memory(S.q7_stream(t.bid, "10 seconds"), "s_late").collect()
    assert {(r.window_end_ns - BASE) // NS_PER_SECOND: r.price for r in got} == {10: 10, 30: 50, 40: 20}


def test_early_bids_wait_for_their_auction_and_are_purged(spark):
    folder = write_feed(spark, [
        [bid_event(1, 30, 5), bid_event(1, 40, 6), bid_event(2, 70, 3)],  # both auctions unknown yet
        [auction_event(1, 4, 50), bid_event(9, 1, 4)],  # auction 1 takes its early bids
        [bid_event(1, 35, 20), bid_event(9, 1, 30)],
        [auction_event(2, 40, 60), bid_event(2, 5, 45)],  # the bid at 3 s came before auction 2 began
        [bid_event(9, 1, 1000)], [bid_event(9, 1, 1001)]])
    t = stream_tables(spark, folder, "0 seconds")
    got = run_to_memory(S.closed_auctions_stream(t.auction, t.bid), "s_early").collect()
    assert {r.auction: r.price for r in got} == {1: 40, 2: 5}


def test_q3_state_bound(spark, feed):
    """With a bound only pairs that close in time join; a wide one gives all."""
    events, folder = feed
    b = demux(events)
    t = stream_tables(spark, folder)
    ok, n = same(run_to_memory(S.q3_stream(t.auction, t.person, "1 hour"), "s_q3_wide"), q3_local_items(b.auction, b.person))
    assert ok and n[0] > 0, n
    t = stream_tables(spark, folder)
    got = run_to_memory(S.q3_stream(t.auction, t.person, "1 second"), "s_q3_near")
    near = (b.auction.alias("a").where("category = 10").join(
        b.person.alias("p").where("state IN ('OR', 'ID', 'CA')"),
        F.expr(f"a.seller = p.id AND abs(a.date_time_ns - p.date_time_ns) <= {NS_PER_SECOND}"))
        .selectExpr("p.name", "p.city", "p.state", "a.id AS auction_id"))
    ok, m = same(got, near)
    assert ok and 0 < m[0] < n[0], m


def test_chained_means(spark, feed):
    events, folder = feed
    b = demux(events)
    closed_batch = closed_auctions(b.auction, b.bid)
    sink = run_to_folder(closed_stream(spark, folder))
    closed = spark.readStream.schema(CLOSED).parquet(sink)
    ok, n = same(run_to_memory(S.q4_running_stream(closed), "s_q4r"), q4_running_avg(closed_batch))
    assert ok, n
    closed = spark.readStream.schema(CLOSED).parquet(sink)
    ok, n = same(run_to_memory(S.q6_stream(closed, "bidder"), "s_q6"), q6_last_avg(closed_batch, "bidder"))
    assert ok, n
    closed = spark.readStream.schema(CLOSED).parquet(sink)
    got = run_to_memory(S.q4_category_avg_stream(closed), "s_q4", mode="complete")
    ok, n = same(got, q4_category_avg(closed_batch))
    assert ok, n
