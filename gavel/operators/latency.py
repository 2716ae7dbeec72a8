"""Latency reports over (t_ns, latency_ns) samples: CCDF and timeline.

Both work on a histogram, never on raw samples per group: samples are first
counted per bucket (a partial aggregate, skew-proof), and percentiles and
tail fractions are read off the cumulative bucket counts. A bucket is either
linear (`width`) or log-linear (`sig_bits`: keep the top sig_bits+1 bits, as
high-dynamic-range histograms do), which bounds the buckets per group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavel.functions.time import duration_ns, window_end_ns
from gavel.operators.running import running_frame

# Percentiles of the timeline, in thousandths: 25, 50, 75, 95, 99, 99.9 and max.
TIMELINE_PERMILLE = [250, 500, 750, 950, 990, 999]
TIMELINE_NAMES = ["p25", "p50", "p75", "p95", "p99", "p999"]


def bucket(latency: Column, width: int | None = None, sig_bits: int | None = None) -> Column:
    """Lower bound of the histogram bucket of a non-negative LONG latency."""
    if (width is None) == (sig_bits is None):
        raise ValueError("give exactly one of width or sig_bits")
    if width is not None:
        return latency - F.pmod(latency, F.lit(width))
    # exponent of the highest set bit, exact: log2 then a one-step correction
    e = F.floor(F.log2(F.greatest(latency, F.lit(1)).cast("double"))).cast("int")
    shl = lambda a, b: F.call_function("shiftleft", a, b)
    e = F.when(shl(F.lit(1).cast("long"), e) > latency, e - 1).otherwise(e)
    shift = F.greatest(e - F.lit(sig_bits), F.lit(0))
    return shl(F.call_function("shiftright", latency, shift), shift)


def trim(samples: DataFrame, start_ns: int | Column, end_ns: int | Column, warmup: str | int = "2 seconds",
         cooldown: str | int = "2 seconds") -> DataFrame:
    """Keep samples of the steady part of a run: [start + warmup, end - cooldown)."""
    lo, hi = start_ns + duration_ns(warmup), end_ns - duration_ns(cooldown)
    return samples.where((F.col("t_ns") >= lo) & (F.col("t_ns") < hi))


def _weight(samples: DataFrame) -> Column:
    """How many samples the rows of a group stand for: their `rows` (input rows
    of a micro-batch) if there is such a column, else one each."""
    return F.sum("rows") if "rows" in samples.columns else F.count(F.lit(1))


def _counted(samples: DataFrame) -> list[str]:
    return ["rows"] if "rows" in samples.columns else []


def latency_ccdf(samples: DataFrame, width: int | None = None, sig_bits: int | None = None) -> DataFrame:
    """(latency, ccdf, samples): per bucket, the fraction of samples at or above it."""
    hist = (samples.select(bucket(F.col("latency_ns"), width, sig_bits).alias("latency"), *_counted(samples))
            .groupBy("latency").agg(_weight(samples).alias("samples")).where(F.col("samples") > 0))
    return ccdf_of_histogram(hist, bounded=sig_bits is not None)


def ccdf_of_histogram(hist: DataFrame, bounded: bool) -> DataFrame:
    """The CCDF of (latency, samples), a row per bucket. `bounded`: the buckets are log-linear."""
    if bounded:
        # At most 64 * 2^sig_bits buckets, so one window over them is small.
        w = Window.partitionBy(F.lit(0)).orderBy(F.col("latency").desc())
        return (hist.withColumns({"frame_sum": F.sum("samples").over(w.rowsBetween(Window.unboundedPreceding, 0)),
                                  "total": F.sum("samples").over(Window.partitionBy(F.lit(0)))})
                .select("latency", (F.col("frame_sum") / F.col("total").cast("double")).alias("ccdf"), "samples"))
    # Buckets of a fixed width are as many as the latencies' spread: suffix
    # sums from the top bucket down, by ranges (no single task).
    desc = hist.select(F.lit(0).alias("g"), (-F.col("latency")).alias("neg"), "latency", "samples")
    r = running_frame(desc, keys=["g"], order=["neg"], value="samples")
    total = r.agg(F.max("frame_sum").cast("double")).scalar()
    return r.select("latency", (F.col("frame_sum") / total).alias("ccdf"), "samples")


def latency_timeline(samples: DataFrame, slot: str | int = "250 milliseconds", width: int | None = None,
                     sig_bits: int | None = None) -> DataFrame:
    """Per time slot (labelled by its end): p25 p50 p75 p95 p99 p999 and max.

    Percentiles are nearest-rank on bucket values: the smallest bucket whose
    cumulative count reaches p * n.
    """
    slot_ns = duration_ns(slot)
    hist = (samples.select(window_end_ns("t_ns", slot_ns).alias("slot_end_ns"),
                           bucket(F.col("latency_ns"), width, sig_bits).alias("b"), *_counted(samples))
            .groupBy("slot_end_ns", "b").agg(_weight(samples).alias("c")).where(F.col("c") > 0))
    totals = hist.groupBy("slot_end_ns").agg(F.sum("c").alias("n"))
    if sig_bits is not None:
        # Rows per slot are bounded by the log-linear buckets, so a per-slot window is small.
        w = Window.partitionBy("slot_end_ns").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
        cum = hist.withColumn("cum", F.sum("c").over(w))
    else:
        # Buckets of a fixed width are as many as a slot's spread: cumulative counts by ranges.
        cum = running_frame(hist, keys=["slot_end_ns"], order=["b"], value="c").withColumnRenamed("frame_sum", "cum")
    cum = cum.join(totals, "slot_end_ns")
    aggs = [F.min(F.when(F.col("cum") * 1000 >= F.col("n") * pm, F.col("b"))).alias(name)
            for pm, name in zip(TIMELINE_PERMILLE, TIMELINE_NAMES)]
    return (cum.groupBy("slot_end_ns").agg(*aggs, F.max("b").alias("max"), F.max("n").alias("samples")))


def samples_from_events(events: DataFrame) -> DataFrame:
    """Check input: t = events.ts, latency = round(value * 100)."""
    from gavel.functions.time import ns_of
    return events.select(ns_of("ts").alias("t_ns"), F.round(F.col("value") * 100).cast("long").alias("latency_ns"))
