"""Closed auctions of a tagged event stream by session windows: built-in operators, one read of the source, no
bound on an auction's length.

An auction opens a session that lasts until it expires; a bid is a session of a moment. Sessions of one auction id
that overlap merge, so an auction's session holds just the bids that came while it was open, in whatever order
they arrived, and leaves once the watermark has passed its end, when no such bid can come any more. The winner
is the best bid of the session, if it reaches the reserve (if the best doesn't, none does). Bids outside every
session are sessions of their own; they leave with the watermark too.

Spark merges sessions that only touch, and has times in microseconds, while the validity test is exact in ns. So
sessions run on a clock of three ticks a ns, written as TIMESTAMP microseconds (it holds dates up to 2067; later ones
raise): an auction from t to e spans [3t, 3e - 1), a bid at b spans [3b + 1, 3b + 2), and neither two bids nor
a bid and an auction that it doesn't belong to touch.

Hot auctions: with `salts` > 1 a bid goes to one of that many salts and an auction to all of them; each salt has its
own session and partial winner, and a second aggregation over the same session picks the winner, in the
same query. So half of all bids on one auction are that many tasks' work. An auction in every salt is that many
rows of state, so a caller that knows the hot ids (`hot_auctions`) names them in `hot`, and only they are salted. Which
ids are salted changes no result.

With `per_batch`, the rows of a (large) micro-batch, the same sessions are found by blocks of ids (`blocks`), whose state is
a row per block; without it by Spark's session windows, whose state is a row per session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel.functions.time import duration_ns
from gavel.operators.closing import CLOSED_COLS
from gavel.streaming.blocks import block_labels, closed_by_blocks, rows_by_blocks
from gavel.streaming.sources import state_shards

TICKS = 3
SALTS = 4

# Fewer bids than this on an auction are no task's burden.
HOT_BIDS = 10_000


def tick(ns: Column) -> Column:
    """ns -> a TIMESTAMP on the clock of the sessions."""
    return F.timestamp_micros(ns * F.lit(TICKS))


def hot_auctions(bid: DataFrame, rows: int, shards: int) -> list[int]:
    """Ids with over a quarter of what a shard gets of `rows` rows, a micro-batch's; a bounded list, by one aggregation."""
    least = max(HOT_BIDS, rows // (4 * shards))
    counts = bid.where("auction IS NOT NULL").groupBy("auction").agg(F.count(F.lit(1)).alias("n"))
    return [r.auction for r in counts.where(F.col("n") > least).collect()]


def session_rows(events: DataFrame, salts: int = SALTS, hot: list[int] | None = None) -> DataFrame:
    """Auctions and bids of tagged events as sessions: (id, salt, begin, ticks, a, b, rank). With `hot`, only those ids are salted."""
    if salts < 1:
        raise ValueError("salts must be at least 1")
    a, b, opens = F.col("auction"), F.col("bid"), F.col("type") == "Auction"
    begin = F.when(opens, a["date_time_ns"] * TICKS).otherwise(b["date_time_ns"] * TICKS + 1)
    ticks = F.when(opens, (a["expires_ns"] - a["date_time_ns"]) * TICKS - 1).otherwise(F.lit(1))
    rows = events.where(F.col("type").isin("Auction", "Bid")).select(
        F.coalesce(a["id"], b["auction"]).alias("id"), F.timestamp_micros(begin).alias("begin"), ticks.alias("ticks"),
        F.when(opens, F.struct(a["category"], a["seller"], a["expires_ns"], a["reserve"])).alias("a"),
        F.when(~opens, F.struct(b["bidder"], b["price"], b["date_time_ns"].alias("bid_time_ns"))).alias("b"),
        # Order of winners: price up, time down, bidder down.
        F.when(~opens, F.struct(b["price"], -b["date_time_ns"], -b["bidder"])).alias("rank"))
    rows = rows.where("id IS NOT NULL AND begin IS NOT NULL")
    if salts == 1 or hot == []:
        return rows.withColumn("salt", F.lit(0))
    one = F.array(F.pmod(F.xxhash64("b"), F.lit(salts)).cast("int"))
    dealt = F.when(F.col("a").isNotNull(), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(one)
    if hot is not None:
        dealt = F.when(F.col("id").isin(hot), dealt).otherwise(F.array(F.lit(0)))
    return rows.withColumn("salt", F.explode(dealt))


def closed_auctions_sessions(events: DataFrame, delay: str | int = "0 seconds", salts: int = SALTS, hot: list[int] | None = None,
                             per_batch: int | None = None) -> DataFrame:
    """(auction, category, seller, expires_ns, bidder, price, bid_time_ns) of every closed auction, once the watermark
    (the latest time of any auction or bid, less `delay`) has passed its expiry. Auction ids are unique. With
    `per_batch`, the rows of a micro-batch, by blocks; only the ids in `hot` are salted then."""
    if per_batch is not None:
        hot = hot or []
    rows = session_rows(events, salts, hot).withWatermark("begin", f"{duration_ns(delay) * TICKS} microseconds")
    if per_batch is not None:
        spark = events.sparkSession
        labels = block_labels(spark, per_batch, state_shards(spark, rows_by_blocks(per_batch)), salts if hot else 1)
        return closed_by_blocks(rows, labels, hot).select(*CLOSED_COLS)
    span = F.expr("make_interval(0, 0, 0, 0, 0, 0, CAST(ticks AS DECIMAL(20, 0)) / 1000000)")
    best = F.max_by("b", "rank").alias("b")
    won = (rows.groupBy("id", "salt", F.session_window("begin", span).alias("session"))
           .agg(F.max("a").alias("a"), best, F.max("rank").alias("rank"))
           .where("a IS NOT NULL AND b.price >= a.reserve"))
    if salts > 1 and hot != []:
        won = won.groupBy("id", "session").agg(F.max("a").alias("a"), best)
    return won.select(F.col("id").alias("auction"), "a.category", "a.seller", "a.expires_ns", "b.bidder", "b.price", "b.bid_time_ns").select(*CLOSED_COLS)
