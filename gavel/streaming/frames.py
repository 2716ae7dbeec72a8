"""Running means of a closing stream, micro-batch by micro-batch on built-in operators.

`queries.q4_running_stream` and `q6_stream` keep each key's closings in one task.
Here a micro-batch goes through the batch operator instead (`running_frame`:
ranges over (key, order), no task per key), and a `KeyedLog` carries what
earlier micro-batches leave behind: per key the sum and count, or the last k-1
closings. A micro-batch reads and writes the state of its own keys only. The
closing operators emit an auction only once the watermark has passed its expiry,
so later micro-batches come later in closing order.

Results are written per micro-batch id with overwrite, so a micro-batch that
runs again after a failure leaves the same files. Several means can share one
closing query (`fanout.fan_out`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from gavel.functions.time import idiv
from gavel.operators.averages import CLOSING_ORDER
from gavel.operators.running import running_frame
from gavel.streaming.fanout import Sink, fan_out
from gavel.streaming.upserts import EVERY, KeyedLog

SUMS = "key long, s long, n long"
TAILS = "key long, tail array<struct<expires_ns: long, auction: long, price: long>>"


def _of_batch(log: KeyedLog, rows: DataFrame, batch_id: int) -> DataFrame:
    """The state of the keys of a micro-batch."""
    before, keys = log.before(batch_id), rows.select(F.col("key").alias("k")).distinct()
    return before.join(keys, F.col("key").eqNullSafe(F.col("k")), "left_semi")


def _running(batch: DataFrame, batch_id: int, key: str, out: str, log: KeyedLog) -> None:
    rows = batch.select(F.col(key).alias("key"), *CLOSING_ORDER, "price")
    before = _of_batch(log, rows, batch_id).persist()
    try:
        total = before.unionByName(rows.groupBy("key").agg(F.sum("price").alias("s"), F.count("price").alias("n")))
        log.put(total.groupBy("key").agg(F.sum("s").alias("s"), F.sum("n").alias("n")), batch_id)
        framed = running_frame(rows, ["key"], CLOSING_ORDER, "price")
        old = before.select(F.col("key").alias("k"), "s", "n")
        carried = framed.join(old, F.col("key").eqNullSafe(F.col("k")), "left")
        mean = idiv(F.col("frame_sum") + F.coalesce("s", F.lit(0)), F.col("frame_count") + F.coalesce("n", F.lit(0)))
        (carried.select(F.col("key").alias(key), "auction", "expires_ns", mean.alias("avg_price"))
         .write.mode("overwrite").parquet(f"{out}/batch={batch_id}"))
    finally:
        before.unpersist()


def _last_k(batch: DataFrame, batch_id: int, key: str, k: int, out: str, log: KeyedLog) -> None:
    rows = batch.select(F.col(key).alias("key"), *CLOSING_ORDER, "price")
    tails = _of_batch(log, rows, batch_id).select("key", F.explode("tail").alias("t")).select("key", "t.*")
    both = tails.select("key", *CLOSING_ORDER, "price", F.lit(0).alias("new")).unionByName(rows.select("*", F.lit(1).alias("new"))).persist()
    try:
        framed = running_frame(both, ["key"], ["new", *CLOSING_ORDER], "price", last_k=k)
        (framed.where("new = 1").select(F.col("key").alias(key), "auction", "expires_ns", idiv("frame_sum", F.col("frame_count")).alias("avg_price"))
         .write.mode("overwrite").parquet(f"{out}/batch={batch_id}"))
        # The latest k-1 closings of a key; Spark cuts each task's rows to k-1 a key before the shuffle.
        latest = Window.partitionBy("key").orderBy(F.desc("new"), *[F.desc(c) for c in CLOSING_ORDER])
        tail = both.withColumn("at", F.row_number().over(latest)).where(F.col("at") <= k - 1)
        last = F.array_sort(F.collect_list(F.struct("expires_ns", "auction", "price")))
        log.put(tail.groupBy("key").agg(last.alias("tail")), batch_id)
    finally:
        both.unpersist()


def means_sink(spark: SparkSession, sink_path: str, state_path: str, key: str = "category", last: int | None = None,
               every: int = EVERY) -> Sink:
    """A sink of closed auctions that writes (key, auction, expires_ns, avg_price) into `sink_path`, one folder per
    micro-batch: the mean of all closings of the key so far, or of its last `last`. `state_path` is a folder of this
    sink alone, in shared storage."""
    log = KeyedLog(spark, state_path, SUMS if last is None else TAILS, ["key"], every)

    def write(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():  # nothing has closed
            log.put(spark.createDataFrame([], log.schema), batch_id)
        elif last is None:
            _running(batch, batch_id, key, sink_path, log)
        else:
            _last_k(batch, batch_id, key, last, sink_path, log)
    return write


def running_means(closed: DataFrame, sink_path: str, state_path: str, key: str = "category",
                  last: int | None = None) -> DataStreamWriter:
    """A query of one `means_sink`."""
    return fan_out(closed, {"means": means_sink(closed.sparkSession, sink_path, state_path, key, last)})
