"""Stream equality check: do two results hold the same rows per timestamp?

Rows carry their time as a column, so "same multiset per timestamp" is "same
multiset of (time, row)". Each side is read once: rows are counted with
+1 (left) / -1 (right) in one aggregation on the full row, and a row whose
count is not zero is reported once, with that count, on the side that has more.
An empty result means the two are equal. The aggregation is partial/final
and shuffles on the whole row, so no time slot meets in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff_by_time(left: DataFrame, right: DataFrame, time_col: str) -> DataFrame:
    """(side, time_col, other columns..., n_more) of rows present more often on
    one side, and how many times more."""
    if "n_more" in left.columns or "side" in left.columns:
        raise ValueError("the compared columns may not be named side or n_more")
    if sorted(left.columns) != sorted(right.columns):
        raise ValueError(f"column sets differ: {left.columns} vs {right.columns}")
    cols = [time_col] + sorted(c for c in left.columns if c != time_col)
    signed = (left.select(*cols, F.lit(1).alias("_d"))
              .unionByName(right.select(*cols, F.lit(-1).alias("_d"))))
    net = (signed.groupBy(*cols).agg(F.sum("_d").alias("_n"))
           .where(F.col("_n") != 0))
    side = F.when(F.col("_n") > 0, F.lit("left")).otherwise(F.lit("right"))
    return net.select(side.alias("side"), *cols, F.abs("_n").alias("n_more"))


def assert_same_by_time(left: DataFrame, right: DataFrame, time_col: str, show: int = 5) -> None:
    d = diff_by_time(left, right, time_col)
    bad = d.limit(show).collect()  # only a sample of a failing diff is shown
    if bad:
        raise AssertionError(f"results differ, e.g. {bad}")
