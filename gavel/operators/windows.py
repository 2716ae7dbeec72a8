"""Windowed bid analytics: Q5 hot items (sliding), Q7 highest bid (tumbling).

Windows are labelled by their exclusive end in ns; a bid exactly on a
boundary belongs to the later window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gavel.functions.time import NS_PER_US, duration_ns, event_time, floor_to, window_end_ns

# Reference workload constants (the registered queries pass their own sizes).
Q5_SIZE, Q5_SLIDE = "60 seconds", "1 second"
Q7_SIZE = "10 seconds"


def _top_auction(counts: DataFrame) -> DataFrame:
    """Per window the auction with most bids; ties go to the higher id.

    max(struct(n, auction)) is a partial/final aggregate: each task keeps one
    candidate per window before the shuffle.
    """
    best = F.max(F.struct("n", "auction"))
    return (counts.groupBy("window_end_ns").agg(best.alias("b"))
            .select("window_end_ns", "b.auction", "b.n"))


def sliding(size: str | int, slide: str | int) -> tuple[int, int]:
    """Size and slide in ns. The size must be a multiple of the slide, and both
    whole microseconds, the resolution of event time."""
    size_ns, slide_ns = duration_ns(size), duration_ns(slide)
    if slide_ns <= 0 or size_ns <= 0 or size_ns % slide_ns:
        raise ValueError("window size must be a multiple of the slide")
    if slide_ns % NS_PER_US:
        raise ValueError("window size and slide must be whole microseconds")
    return size_ns, slide_ns


def q5_hot_items(bid: DataFrame, size: str | int = Q5_SIZE, slide: str | int = Q5_SLIDE) -> DataFrame:
    """Q5: count bids per (slide, auction) first, then add each pane count into
    the size/slide windows that hold it, then take the top auction.

    The fan-out to windows happens after the first aggregation, on pane
    counts, not on raw bids.
    """
    size_ns, slide_ns = sliding(size, slide)
    panes = (bid.select(window_end_ns("date_time_ns", slide_ns).alias("pane_end"), "auction")
             .groupBy("pane_end", "auction").agg(F.count(F.lit(1)).alias("c")))
    offsets = F.sequence(F.lit(0), F.lit(size_ns // slide_ns - 1))
    windows = (panes.select(F.explode(offsets).alias("i"), "pane_end", "auction", "c")
               .select((F.col("pane_end") + F.col("i").cast("long") * F.lit(slide_ns)).alias("window_end_ns"),
                       "auction", "c")
               .groupBy("window_end_ns", "auction").agg(F.sum("c").alias("n")))
    return _top_auction(windows)


q5_hot_items_panes = q5_hot_items


def q5_hot_items_deltas(bid: DataFrame, size: str | int = Q5_SIZE, slide: str | int = Q5_SLIDE) -> DataFrame:
    """Q5 by adding and retracting: a pane's bids enter when it begins to count and leave one window size later, so an
    auction's count is constant between such moments, and a pane makes three rows instead of size/slide copies.

    Time is cut into blocks of one window size. What counts when a block begins are just the panes of the block
    before, so each block adds up on its own: their bids enter at its start and leave as they came, its own bids
    enter. A block has at most size/slide moments, so neither an auction's rows in a block nor a block's stretches
    (from, to) grow with the data, whatever auction is hot. Each stretch keeps its best auction (partial/final), and
    only these few are laid out over the windows they span.
    """
    size_ns, slide_ns = sliding(size, slide)
    panes = (bid.select(window_end_ns("date_time_ns", slide_ns).alias("at"), "auction")
             .groupBy("at", "auction").agg(F.count(F.lit(1)).alias("c")))
    block, later = floor_to("at", size_ns), floor_to("at", size_ns) + F.lit(size_ns)
    enters = panes.select("auction", block.alias("block"), "at", F.col("c").alias("d"))
    carried = panes.select("auction", later.alias("block"), later.alias("at"), F.col("c").alias("d"))
    leaves = panes.select("auction", later.alias("block"), (F.col("at") + F.lit(size_ns)).alias("at"), (-F.col("c")).alias("d"))
    moments = (enters.unionByName(carried).unionByName(leaves).groupBy("auction", "block", "at").agg(F.sum("d").alias("d")))
    w = Window.partitionBy("auction", "block").orderBy("at")
    stretches = moments.select("block", "auction", "at", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("n"),
                               F.coalesce(F.lead("at").over(w), F.col("block") + F.lit(size_ns)).alias("to"))
    best = (stretches.where("n > 0").groupBy("at", "to").agg(F.max(F.struct("n", "auction")).alias("b")))
    ends = F.sequence(F.col("at"), F.col("to") - F.lit(slide_ns), F.lit(slide_ns))
    return _top_auction(best.select(F.explode(ends).alias("window_end_ns"), "b.n", "b.auction"))


def q5_hot_items_by_window(bid: DataFrame, size: str | int = Q5_SIZE, slide: str | int = Q5_SLIDE) -> DataFrame:
    """Q5 with Spark's sliding window(), which copies every bid into each of
    its windows; the second form of the stream-equality check."""
    size_ns, slide_ns = sliding(size, slide)
    w = F.window(event_time("date_time_ns"), f"{size_ns // NS_PER_US} microseconds",
                 f"{slide_ns // NS_PER_US} microseconds")
    counts = (bid.groupBy(w.alias("w"), "auction").agg(F.count(F.lit(1)).alias("n"))
              .select((F.unix_micros(F.col("w.end")) * F.lit(1000)).alias("window_end_ns"), "auction", "n"))
    return _top_auction(counts)


def q7_highest_bid(bid: DataFrame, size: str | int = Q7_SIZE) -> DataFrame:
    """Q7: (window_end_ns, price) highest bid price per tumbling window."""
    size_ns = duration_ns(size)
    return (bid.groupBy(window_end_ns("date_time_ns", size_ns).alias("window_end_ns"))
            .agg(F.max("price").alias("price")))
