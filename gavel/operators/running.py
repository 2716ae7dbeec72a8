"""Running frames per key in a total order, without one task per key.

`rows between unbounded preceding and current row` (q4 running mean) and
`rows between k-1 preceding and current row` (q6 last-k mean) over
`Window.partitionBy(key)` would put every row of a key in one task; with five
categories, or one bidder holding a third of all rows, that is one task for a
large share of the data. Instead rows are range-partitioned on (key, order),
each row keeps the number of its range, and the window runs over (range, key):

* the rows before a range are summed up in one small carry row per
  (range, key), for the keys that reach into several ranges only (at most two
  keys of a range do), which a join with null-safe equality adds to the
  window's result;
* for the last-k frame the carry is the k-1 rows before the range; copies of
  them join the range's rows, and leave after the window.

Everything is a built-in expression: NULL keys form one group as in any
window, NULL values are skipped by sum and count, and a sum beyond LONG
raises under ANSI as Spark's own window does.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE = "__range"


def _same(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    cond = F.lit(True)
    for a, b in pairs:
        cond = cond & left[a].eqNullSafe(right[b])
    return cond


def _ranged(df: DataFrame, sort_cols: list[str], num_partitions: int | None) -> DataFrame:
    """`df` with the number of each row's range of `sort_cols`, checkpointed, so
    that every later job sees the same ranges and the lineage ends here."""
    from gavel.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    # The range partitioner samples its input before shuffling it; keeping the
    # input for this one job stops the sample from recomputing the upstream.
    # A caller's own cache is left as it is.
    level = df.storageLevel
    cached = level.useMemory or level.useDisk
    src = df if cached else df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        ranged = (src.repartitionByRange(num_partitions, *sort_cols) if num_partitions
                  else src.repartitionByRange(*sort_cols))
        return ranged.withColumn(RANGE, F.spark_partition_id()).checkpoint(eager=True)
    finally:
        if not cached:
            src.unpersist()


def _carries(ranged: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(range, keys, sum, count and rows before the range) of keys that began in an earlier range."""
    total = ranged.groupBy(RANGE, *keys).agg(F.sum(value).alias("s"), F.count(value).alias("n"),
                                             F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    return (total.select(F.col(RANGE).alias("c_range"), *[F.col(k).alias(f"c_{i}") for i, k in enumerate(keys)],
                         F.sum("s").over(before).alias("c_sum"), F.sum("n").over(before).alias("c_count"),
                         F.sum("rows").over(before).alias("c_rows"))
            .where(F.col("c_rows") > 0))


def running_frame(df: DataFrame, keys: list[str], order: list[str], value: str,
                  last_k: int | None = None, num_partitions: int | None = None) -> DataFrame:
    """Add `frame_sum` and `frame_count` (of non-NULL values) to every row of `df`.

    The frame is all earlier rows of the same key in `order` (`last_k=None`)
    or the last `last_k` rows, the current row included. `order` must be a
    total order within a key (ties give an arbitrary but fixed order).
    """
    if last_k is not None and last_k < 1:
        raise ValueError("last_k must be at least 1")
    columns = df.columns
    ranged = _ranged(df, keys + order, num_partitions)
    carry = _carries(ranged, keys, value)
    names = [(RANGE, "c_range")] + [(k, f"c_{i}") for i, k in enumerate(keys)]
    if last_k is None:
        w = Window.partitionBy(RANGE, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        own = ranged.withColumns({"o_sum": F.sum(value).over(w), "o_count": F.count(value).over(w)})
        out = own.join(carry, _same(own, carry, names), "left")
        both = F.col("o_sum") + F.col("c_sum")
        return out.select(*columns, F.coalesce(both, "o_sum", "c_sum").alias("frame_sum"),
                          (F.col("o_count") + F.coalesce("c_count", F.lit(0))).alias("frame_count"))
    own = ranged.select(*columns, RANGE, F.lit(1).alias("__own"))
    if last_k > 1:
        own = own.unionByName(_tails(ranged, carry, columns, keys, order, last_k))
    w = Window.partitionBy(RANGE, *keys).orderBy("__own", *order).rowsBetween(-(last_k - 1), 0)
    framed = own.withColumns({"frame_sum": F.sum(value).over(w), "frame_count": F.count(value).over(w)})
    return framed.where(F.col("__own") == 1).select(*columns, "frame_sum", "frame_count")


def _tails(ranged: DataFrame, carry: DataFrame, columns: list[str], keys: list[str], order: list[str],
           last_k: int) -> DataFrame:
    """The last_k - 1 rows before each range of a key that began earlier, as
    rows of that range. A row with number r of its key is wanted by the ranges
    whose first row has one of the numbers r + 1 .. r + last_k - 1."""
    keyed = [(k, f"c_{i}") for i, k in enumerate(keys)]
    spread = carry.select(*[c for _, c in keyed]).distinct()
    rows = ranged.join(spread, _same(ranged, spread, keyed), "left_semi")
    part = Window.partitionBy(RANGE, *keys)
    rows = rows.withColumns({"__at": F.row_number().over(part.orderBy(*order)),
                             "__size": F.count(F.lit(1)).over(part)})
    rows = rows.where(F.col("__size") - F.col("__at") < last_k - 1)
    begun = carry.select(F.col("c_range").alias("b_range"), *[F.col(c).alias(f"b_{c}") for _, c in keyed],
                         F.col("c_rows").alias("b_rows"))
    rows = rows.join(begun, _same(rows, begun, [(RANGE, "b_range")] + [(k, f"b_{c}") for k, c in keyed]), "left")
    number = F.col("__at") + F.coalesce("b_rows", F.lit(0))
    rows = rows.select(*columns, F.explode(F.sequence(number, number + F.lit(last_k - 2))).alias("__before"))
    # c_rows rows precede a range, so its first row has number c_rows + 1.
    wanted = rows.join(carry, _same(rows, carry, keyed + [("__before", "c_rows")]))
    return wanted.select(*columns, F.col("c_range").alias(RANGE), F.lit(0).alias("__own"))
