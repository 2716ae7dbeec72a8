"""As-of join: the latest row of the same key at or before a time, without one task per key.

Rows of both sides are range-partitioned on (key, time); within a range the latest value of the right side is a
last-value frame over the rows of a key so far, and what came before a range is one small carry row for each key that
began in an earlier range (at most two keys of a range did). So a key that holds a third of all rows is
spread over a third of the ranges. Everything is a built-in expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gavel.operators.joins import Q3_CATEGORY, Q3_STATES
from gavel.operators.running import RANGE, _ranged


def latest_before(left: DataFrame, right: DataFrame, key: tuple[str, str], time: tuple[str, str], prefix: str = "latest_",
                  num_partitions: int | None = None) -> DataFrame:
    """Every row of `left` whose key has a row in `right` at or before its time, with the columns of the latest such
    row, named with `prefix`. Of several at that time the greatest by all columns counts. Rows without a key or a
    time match nothing."""
    r = right.where(F.col(key[1]).isNotNull() & F.col(time[1]).isNotNull())
    l = left.where(F.col(key[0]).isNotNull() & F.col(time[0]).isNotNull())
    value = F.struct(*[F.col(c).alias(f"{prefix}{c}") for c in right.columns])
    row = F.struct(*left.columns)
    both = r.select(F.col(key[1]).alias("k"), F.col(time[1]).alias("t"), F.lit(0).alias("side"), value.alias("v"),
                    F.lit(None).cast(l.select(row.alias("r")).schema["r"].dataType).alias("r"))
    both = both.unionByName(l.select(F.col(key[0]).alias("k"), F.col(time[0]).alias("t"), F.lit(1).alias("side"),
                                     F.lit(None).cast(both.schema["v"].dataType).alias("v"), row.alias("r")))
    order = ["t", "side", "v"]
    ranged = _ranged(both, ["k", *order], num_partitions)
    # The last value of each key and range, handed on to the key's later ranges.
    ends = ranged.groupBy(RANGE, "k").agg(F.max_by("v", F.when(F.col("side") == 0, F.struct("t", "v"))).alias("v"))
    before = Window.partitionBy("k").orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(F.col(RANGE).alias("c_range"), F.col("k").alias("c_k"), F.last("v", ignorenulls=True).over(before).alias("c_v"))
    carry = carry.where("c_v IS NOT NULL")
    own = Window.partitionBy(RANGE, "k").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    seen = ranged.withColumn("o_v", F.last("v", ignorenulls=True).over(own)).where("side = 1")
    met = seen.join(carry, (seen[RANGE] == carry["c_range"]) & (seen["k"] == carry["c_k"]), "left")
    return met.select("r", F.coalesce("o_v", "c_v").alias("v")).where("v IS NOT NULL").select("r.*", "v.*")


def q3_latest_registration(auction: DataFrame, person: DataFrame, category: int = Q3_CATEGORY,
                           states: list[str] = Q3_STATES) -> DataFrame:
    """Q3 where people register again: an auction belongs to its seller's latest registration when it opens, and only
    that one's state counts. (name, city, state, auction_id)"""
    a = auction.where(F.col("category") == category).select(F.col("id").alias("auction_id"), "seller", "date_time_ns")
    p = person.select("id", "name", "city", "state", "date_time_ns")
    met = latest_before(a, p, ("seller", "id"), ("date_time_ns", "date_time_ns"))
    return met.where(F.col("latest_state").isin(states)).select(
        F.col("latest_name").alias("name"), F.col("latest_city").alias("city"), F.col("latest_state").alias("state"), "auction_id")
