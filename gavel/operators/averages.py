"""Average closing prices: Q4 per category, Q6 over a key's last ten sales.

All means are integer: sum div count, as the original truncates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavel.functions.time import idiv
from gavel.operators.running import running_frame

Q6_LAST = 10
CLOSING_ORDER = ["expires_ns", "auction"]


def q4_category_avg(closed: DataFrame) -> DataFrame:
    """Q4 final: (category, avg_price) over all closed auctions of a category."""
    return (closed.groupBy("category")
            .agg(F.sum("price").alias("s"), F.count(F.lit(1)).alias("n"))
            .select("category", idiv("s", F.col("n")).alias("avg_price")))


def q4_running_avg(closed: DataFrame) -> DataFrame:
    """Q4 running: one row per closed auction, the category mean so far in
    closing order (expires, then auction id), this auction included."""
    r = running_frame(closed.select("category", "expires_ns", "auction", "price"),
                      keys=["category"], order=CLOSING_ORDER, value="price")
    return r.select("category", "auction", "expires_ns",
                    idiv("frame_sum", F.col("frame_count")).alias("avg_price"))


def q6_last_avg(closed: DataFrame, key: str = "bidder", last: int = Q6_LAST) -> DataFrame:
    """Q6: one row per closed auction, mean of the key's last `last` closing
    prices in closing order, this one included. Key `bidder` (as coded) or
    `seller`."""
    if key not in ("bidder", "seller"):
        raise ValueError("key must be 'bidder' or 'seller'")
    r = running_frame(closed.select(key, "expires_ns", "auction", "price"),
                      keys=[key], order=CLOSING_ORDER, value="price", last_k=last)
    return r.select(key, "auction", "expires_ns",
                    idiv("frame_sum", F.col("frame_count")).alias("avg_price"))
