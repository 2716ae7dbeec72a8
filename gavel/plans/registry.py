"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Every query reads the shared tables through the adapter (gavel.sources), so
its work grows with them. Window sizes follow the fixture choices: the dense
`events` clock carries Q5 (1 h by 10 min) and Q7 (1 h); Q7 also runs with the
original 10 s on the main bid table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gavel.operators.asof import q3_latest_registration
from gavel.operators.averages import q4_category_avg, q4_running_avg, q6_last_avg
from gavel.operators.basic import q0_passthrough, q1_currency, q2_selection
from gavel.operators.closing import closed_auctions
from gavel.operators.diff import diff_by_time
from gavel.operators.latency import latency_ccdf, latency_timeline, samples_from_events, trim
from gavel.operators.joins import q3_local_items, q8_as_written, q8_new_users
from gavel.functions.time import idiv, window_end_ns
from gavel.operators.windows import q5_hot_items, q5_hot_items_by_window, q5_hot_items_deltas, q5_hot_items_panes, q7_highest_bid
from gavel.plans.streams import STREAM_INPUTS, STREAM_QUERIES
from gavel.sources.sinks import report_lines
from gavel.sources.events import demux, event_accessors, events_from_json, events_to_json, flatten, to_events
from gavel.sources.tables import AuctionTables, dense_bids, from_tpch, read_table

Query = Callable[[SparkSession, str], DataFrame]

DENSE_Q5 = ("1 hour", "10 minutes")
DENSE_Q7 = "1 hour"


def _closed(spark: SparkSession, sf: str) -> DataFrame:
    t = from_tpch(spark, sf)
    return closed_auctions(t.auction, t.bid)


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return to_events(from_tpch(spark, sf))


def _registered_again(spark: SparkSession, sf: str) -> AuctionTables:
    """People who register again and again: a third of all sellers and people are one, the others share an id by four."""
    def fewer(c: str) -> Column:
        return F.when(F.pmod(F.col(c), F.lit(3)) == 0, F.lit(0)).otherwise(idiv(c, 4) + 1).cast("long")
    t = from_tpch(spark, sf)
    return AuctionTables(t.person.withColumn("id", fewer("id")), t.auction.withColumn("seller", fewer("seller")), t.bid)


QUERIES: dict[str, Query] = {
    "q0_passthrough": lambda s, d: flatten(q0_passthrough(_events(s, d))),
    "demux_person": lambda s, d: demux(_events(s, d)).person,
    "demux_auction": lambda s, d: demux(_events(s, d)).auction,
    "demux_bid": lambda s, d: demux(_events(s, d)).bid,
    "event_accessors": lambda s, d: event_accessors(_events(s, d)),
    "events_json_roundtrip": lambda s, d: flatten(events_from_json(events_to_json(_events(s, d)))),
    "q1_currency": lambda s, d: q1_currency(from_tpch(s, d).bid),
    "q2_selection": lambda s, d: q2_selection(from_tpch(s, d).bid),
    "q3_local_items": lambda s, d: (lambda t: q3_local_items(t.auction, t.person))(from_tpch(s, d)),
    "closed_auctions": _closed,
    "q4_category_avg": lambda s, d: q4_category_avg(_closed(s, d)),
    "q4_running_avg": lambda s, d: q4_running_avg(_closed(s, d)),
    "q5_hot_items": lambda s, d: q5_hot_items(dense_bids(s, d), *DENSE_Q5),
    "q5_hot_items_panes": lambda s, d: q5_hot_items_panes(dense_bids(s, d), *DENSE_Q5),
    "q5_hot_items_deltas": lambda s, d: q5_hot_items_deltas(dense_bids(s, d), "1 hour", "1 minute"),
    "q6_last10_bidder": lambda s, d: q6_last_avg(_closed(s, d), "bidder"),
    "q6_last10_seller": lambda s, d: q6_last_avg(_closed(s, d), "seller"),
    "q7_highest_bid": lambda s, d: q7_highest_bid(dense_bids(s, d), DENSE_Q7),
    "q7_highest_bid_10s": lambda s, d: q7_highest_bid(from_tpch(s, d).bid, "10 seconds"),
    "q3_latest_registration": lambda s, d: (lambda t: q3_latest_registration(t.auction, t.person))(_registered_again(s, d)),
    "q8_new_users": lambda s, d: (lambda t: q8_new_users(t.person, t.auction, "12 hours"))(from_tpch(s, d)),
    "q8_new_users_30d": lambda s, d: (lambda t: q8_new_users(t.person, t.auction, "30 days"))(from_tpch(s, d)),
    "q8_as_written": lambda s, d: q8_as_written(from_tpch(s, d).auction, "12 hours"),
}


def _samples(spark: SparkSession, sf: str) -> DataFrame:
    return samples_from_events(read_table(spark, sf, "events"))


def _trimmed(spark: SparkSession, sf: str) -> DataFrame:
    """Samples of the steady part: two days off either end of the event clock."""
    samples = _samples(spark, sf)
    start, end = samples.agg(F.min("t_ns")).scalar(), samples.agg(F.max("t_ns")).scalar()
    return trim(samples, start, end + 1, "2 days", "2 days")


def _keyed_windows(bids: DataFrame, key: str) -> DataFrame:
    """Hour windows and a small number derived from a bid: rows that repeat often."""
    return bids.select(window_end_ns("date_time_ns", 3_600 * 10**9).alias("window_end_ns"), F.pmod(key, F.lit(4)).alias("v"))


QUERIES.update({
    "latency_ccdf": lambda s, d: latency_ccdf(_samples(s, d), width=100),
    "latency_ccdf_trimmed": lambda s, d: latency_ccdf(_trimmed(s, d), sig_bits=4),
    "latency_timeline": lambda s, d: latency_timeline(_samples(s, d), "1 hour", width=100),
    "latency_report_lines": lambda s, d: report_lines(
        latency_timeline(_samples(s, d), "1 hour", width=100).select(
            "slot_end_ns", "p25", "p50", "p75", "p95", "p99", "p999", "max"), "summary_timeline", ["slot_end_ns"]),
    # q5 by window() and by panes must agree: the diff is empty.
    "diff_q5_forms": lambda s, d: (lambda b: diff_by_time(
        q5_hot_items_by_window(b, *DENSE_Q5), q5_hot_items(b, *DENSE_Q5), "window_end_ns"))(dense_bids(s, d)),
    # q7 on raw and on converted prices differ in every window.
    "diff_q7_currency": lambda s, d: (lambda b: diff_by_time(
        q7_highest_bid(b, "10 seconds"), q7_highest_bid(q1_currency(b), "10 seconds"), "window_end_ns"))(
        from_tpch(s, d).bid),
    # rows that repeat on both sides, more often on one of them
    "diff_repeated_rows": lambda s, d: (lambda b: diff_by_time(
        _keyed_windows(b, "auction"), _keyed_windows(b, "bidder"), "window_end_ns"))(dense_bids(s, d)),
})
QUERIES.update(STREAM_QUERIES)


# Shared tables each registered query reads (for throughput figures).
_TPCH = ["customer", "orders", "lineitem"]
QUERY_INPUTS: dict[str, list[str]] = {name: _TPCH for name in QUERIES}
QUERY_INPUTS.update({
    "demux_person": ["customer"], "demux_auction": ["orders"], "demux_bid": ["lineitem"],
    "q1_currency": ["lineitem"], "q2_selection": ["lineitem"],
    "q3_local_items": ["customer", "orders"], "q3_latest_registration": ["customer", "orders"], "closed_auctions": ["orders", "lineitem"],
    "q4_category_avg": ["orders", "lineitem"], "q4_running_avg": ["orders", "lineitem"],
    "q6_last10_bidder": ["orders", "lineitem"], "q6_last10_seller": ["orders", "lineitem"],
    "q5_hot_items": ["events"], "q5_hot_items_panes": ["events"], "q5_hot_items_deltas": ["events"], "q7_highest_bid": ["events"],
    "q7_highest_bid_10s": ["lineitem"], "q8_new_users": ["customer", "orders"],
    "q8_new_users_30d": ["customer", "orders"], "q8_as_written": ["orders"],
    "latency_ccdf": ["events"], "latency_ccdf_trimmed": ["events"], "latency_timeline": ["events"],
    "latency_report_lines": ["events"], "diff_q5_forms": ["events"],
    "diff_q7_currency": ["lineitem"], "diff_repeated_rows": ["events"],
})
QUERY_INPUTS.update(STREAM_INPUTS)


def entry_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: Q3, the query of the published baseline run."""
    return QUERIES["q3_local_items"](spark, sf_dir)
