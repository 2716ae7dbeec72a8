"""Latency reports of a live stream of samples (event_time, t_ns, latency_ns, and `rows` if a sample stands for several).

Samples are counted in log-linear buckets (`operators.latency.bucket`), of which there are at most 64 * 2^sig_bits, so
the state of a slot or of a whole run is small whatever the number of samples.

* timeline: counts per (slot, bucket), then, once the watermark has passed a slot's end, its percentiles are read off the
  cumulative counts of its buckets, in the same query;
* CCDF: counts per bucket in update mode into a `KeyedLog`; the CCDF of what has come so far can be read at any time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from gavel.functions.time import NS_PER_US, duration_ns
from gavel.operators.latency import TIMELINE_NAMES, TIMELINE_PERMILLE, bucket, ccdf_of_histogram
from gavel.streaming.upserts import KeyedLog

HISTOGRAM = "latency long, samples long"


def _weight(samples: DataFrame) -> Column:
    return F.sum("rows") if "rows" in samples.columns else F.count(F.lit(1))


def _nearest_rank(counts: Column, total: Column, permille: int) -> Column:
    """The first bucket whose cumulative count reaches the share; `counts` is sorted by bucket."""
    start = F.struct(F.lit(0).cast("long").alias("cum"), F.lit(None).cast("long").alias("found"))

    def step(acc, x):
        cum = acc["cum"] + x["c"]
        return F.struct(cum.alias("cum"), F.coalesce(acc["found"], F.when(cum * 1000 >= total * permille, x["b"])).alias("found"))
    return F.aggregate(counts, start, step, lambda acc: acc["found"])


def latency_timeline_stream(samples: DataFrame, slot: str | int = "250 milliseconds", sig_bits: int = 4) -> DataFrame:
    """Per slot, once it has passed: p25 p50 p75 p95 p99 p999, max and the number of samples, as `latency_timeline`."""
    span = f"{duration_ns(slot) // NS_PER_US} microseconds"
    counts = (samples.groupBy(F.window("event_time", span).alias("w"), bucket(F.col("latency_ns"), sig_bits=sig_bits).alias("b"))
              .agg(_weight(samples).alias("c")).where("c > 0"))
    slots = counts.groupBy("w").agg(F.array_sort(F.collect_list(F.struct("b", "c"))).alias("h"), F.max("b").alias("max"), F.sum("c").alias("samples"))
    ranks = [_nearest_rank(F.col("h"), F.col("samples"), pm).alias(name) for pm, name in zip(TIMELINE_PERMILLE, TIMELINE_NAMES)]
    return slots.select((F.unix_micros(F.col("w.end")) * NS_PER_US).alias("slot_end_ns"), *ranks, "max", "samples")


def ccdf_writer(samples: DataFrame, folder: str, sig_bits: int = 4) -> tuple[DataStreamWriter, KeyedLog]:
    """A writer that keeps the histogram of all samples so far in `folder`, and the log it keeps it in."""
    counts = (samples.groupBy(bucket(F.col("latency_ns"), sig_bits=sig_bits).alias("latency"))
              .agg(_weight(samples).alias("samples")))
    log = KeyedLog(samples.sparkSession, folder, HISTOGRAM, ["latency"])
    return counts.writeStream.outputMode("update").foreachBatch(log.put), log


def ccdf_so_far(log: KeyedLog) -> DataFrame:
    """(latency, ccdf, samples) of all samples so far, as `latency_ccdf`."""
    return ccdf_of_histogram(log.table().where("samples > 0"), bounded=True)
