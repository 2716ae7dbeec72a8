"""Closed auctions: each auction with its winning valid bid.

A bid is valid for its auction when price >= reserve and
auction.date_time <= bid.date_time < auction.expires. The winner is the
highest price, then the earliest bid, then the lowest bidder; auctions without
a valid bid give no row. Arrival order plays no part (bids that come before
their auction count like any other).

Plan: bid JOIN auction on the auction id with the validity test as a residual
condition, then an arg-max per auction. The join leaves rows clustered by
auction, so the arg-max runs in the join's stage. Where one auction holds a
large share of all bids, AQE splits that partition of the join
(`forceOptimizeSkewedJoin`), and the arg-max shuffles its partial results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLOSED_COLS = ["auction", "category", "seller", "expires_ns", "bidder", "price", "bid_time_ns"]


def valid_bid(b: DataFrame, a: DataFrame):
    return ((b["auction"] == a["a_id"]) & (b["price"] >= a["reserve"])
            & (a["a_t"] <= b["b_t"]) & (b["b_t"] < a["expires_ns"]))


def _winner(joined: DataFrame) -> DataFrame:
    # Order key: price up, time down, bidder down -> max is the winner.
    # Grouping on the join key alone lets the aggregate reuse the join's
    # clustering and sort order (no extra exchange or sort after a sort-merge
    # join); the auction's own fields ride along in the value.
    order = F.struct(F.col("price"), -F.col("b_t"), -F.col("bidder"))
    won = F.max_by(F.struct("category", "seller", "expires_ns", "bidder", "price",
                            F.col("b_t").alias("bid_time_ns")), order)
    return (joined.groupBy(F.col("a_id").alias("auction")).agg(won.alias("w"))
            .select("auction", "w.*"))


def closed_auctions(auction: DataFrame, bid: DataFrame) -> DataFrame:
    a = auction.select(F.col("id").alias("a_id"), "reserve", F.col("date_time_ns").alias("a_t"),
                       "expires_ns", "seller", "category")
    b = bid.select("auction", "bidder", "price", F.col("date_time_ns").alias("b_t"))
    return _winner(b.join(a, valid_bid(b, a))).select(*CLOSED_COLS)
