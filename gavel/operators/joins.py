"""Equi and interval joins: Q3 local items, Q8 new users (and as written)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavel.functions.time import duration_ns

# Fixed values of Q3.
Q3_CATEGORY = 10
Q3_STATES = ["OR", "ID", "CA"]
Q8_WINDOW = "12 hours"


def q3_local_items(auction: DataFrame, person: DataFrame, category: int = Q3_CATEGORY,
                   states: list[str] = Q3_STATES) -> DataFrame:
    """Q3: (name, city, state, auction_id) of category-10 auctions by sellers in OR/ID/CA.

    Both filters run before the join (pushed to the scans), then an inner
    equi-join seller = id; AQE splits the partition of a hot seller.
    """
    a = auction.where(F.col("category") == category).select(F.col("id").alias("auction_id"), "seller")
    p = person.where(F.col("state").isin(states)).select("id", "name", "city", "state")
    return a.join(p, a["seller"] == p["id"]).select("name", "city", "state", "auction_id")


def q8_new_users(person: DataFrame, auction: DataFrame, window: str | int = Q8_WINDOW) -> DataFrame:
    """Q8: (id, auction_id) for each auction opened by a person within `window`
    of registering: p.t <= a.t < p.t + window, joined on seller = id.
    """
    w = duration_ns(window)
    a = auction.select(F.col("id").alias("auction_id"), "seller", F.col("date_time_ns").alias("a_t"))
    p = person.select("id", F.col("date_time_ns").alias("p_t"))
    cond = (a["seller"] == p["id"]) & (p["p_t"] <= a["a_t"]) & (a["a_t"] < p["p_t"] + F.lit(w))
    return a.join(p, cond).select("id", "auction_id")


def q8_as_written(auction: DataFrame, window: str | int = Q8_WINDOW) -> DataFrame:
    """Q8 exactly as the original dataflow wires it: both sides read auctions.

    An auction matches the auction whose id equals its seller when it opens
    before that one's time + window; there is no lower time bound.
    """
    w = duration_ns(window)
    a = auction.select(F.col("id").alias("auction_id"), "seller", F.col("date_time_ns").alias("a_t"))
    o = auction.select(F.col("id").alias("id"), F.col("date_time_ns").alias("o_t"))
    return a.join(o, (a["seller"] == o["id"]) & (a["a_t"] < o["o_t"] + F.lit(w))).select("id", "auction_id")
