"""Stateless queries: pass-through, currency conversion, selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavel.functions.time import idiv

# Fixed values of the queries.
DOLLAR_TO_EURO_NUM, DOLLAR_TO_EURO_DEN = 89, 100
Q2_AUCTION_MODULUS = 123


def q0_passthrough(events: DataFrame) -> DataFrame:
    """Q0: every event unchanged."""
    return events.select("*")


def q1_currency(bid: DataFrame) -> DataFrame:
    """Q1: bid prices converted with integer truncation (price * 89 div 100)."""
    return bid.select("auction", "bidder",
                      idiv(F.col("price") * F.lit(DOLLAR_TO_EURO_NUM), DOLLAR_TO_EURO_DEN).alias("price"),
                      "date_time_ns")


def q2_selection(bid: DataFrame, modulus: int = Q2_AUCTION_MODULUS) -> DataFrame:
    """Q2: (auction, price) of bids on every `modulus`-th auction."""
    return bid.where(F.pmod("auction", F.lit(modulus)) == 0).select("auction", "price")
