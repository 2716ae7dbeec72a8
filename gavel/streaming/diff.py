"""Stream equality check on live streams: do two streams hold the same rows per timestamp?

As `operators.diff.diff_by_time`, with the counts in streaming state: a row adds 1 on the left and takes 1 off on the
right, per (time, whole row). Once the watermark has passed a time, what came of it is settled: a count that isn't zero
is reported once, with the side that has more, and leaves the state with the others. With `fail` the query
stops on the first settled difference instead. The aggregation is partial/final on the whole row, so no time meets in
one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff_stream(left: DataFrame, right: DataFrame, time_col: str = "event_time", fail: bool = False) -> DataFrame:
    """(side, time_col, other columns..., n_more) of rows that are settled and present more often on one side.
    `time_col` is a TIMESTAMP with a watermark in both streams."""
    if "n_more" in left.columns or "side" in left.columns:
        raise ValueError("the compared columns may not be named side or n_more")
    if sorted(left.columns) != sorted(right.columns):
        raise ValueError(f"column sets differ: {left.columns} vs {right.columns}")
    cols = [time_col] + sorted(c for c in left.columns if c != time_col)
    signed = left.select(*cols, F.lit(1).alias("_d")).unionByName(right.select(*cols, F.lit(-1).alias("_d")))
    net = signed.groupBy(*cols).agg(F.sum("_d").alias("_n")).where(F.col("_n") != 0)
    side = F.when(F.col("_n") > 0, F.lit("left")).otherwise(F.lit("right"))
    if fail:
        row = F.to_json(F.struct(side.alias("side"), *cols, F.abs("_n").alias("n_more")))
        side = F.when(F.col("_n") == 0, side).otherwise(F.raise_error(F.concat(F.lit("the streams differ: "), row)).cast("string"))
    return net.select(side.alias("side"), *cols, F.abs("_n").alias("n_more"))
