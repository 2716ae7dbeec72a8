"""Latency histogram helpers against plain Python."""

import random

from pyspark.sql import functions as F

from gavel.operators.latency import bucket, latency_ccdf, latency_timeline


def py_bucket(v, bits):
    s = max(v.bit_length() - 1 - bits, 0)
    return (v >> s) << s


def test_log_linear_bucket(spark):
    rnd = random.Random(3)
    vals = [0, 1, 2, 3, 15, 16, 17, 31, 32, 33, 2**40 - 1, 2**40, 2**40 + 1] + \
           [rnd.randrange(0, 2**50) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in vals], "v long")
    got = [r[0] for r in df.select(bucket(F.col("v"), sig_bits=4)).collect()]
    assert got == [py_bucket(v, 4) for v in vals]


def test_ccdf_and_timeline_small(spark):
    rows = [(t * 1_000_000, lat) for t, lat in enumerate([100, 200, 200, 300, 1000])]
    df = spark.createDataFrame(rows, "t_ns long, latency_ns long")
    ccdf = {r.latency: (r.ccdf, r.samples) for r in latency_ccdf(df, width=100).collect()}
    assert ccdf == {100: (1.0, 1), 200: (0.8, 2), 300: (0.4, 1), 1000: (0.2, 1)}
    tl = latency_timeline(df, "1 second", width=100).collect()
    assert len(tl) == 1
    r = tl[0]
    assert (r.p25, r.p50, r.p75, r.p95, r.p99, r.p999, r.max, r.samples) == (200, 200, 300, 1000, 1000, 1000, 1000, 5)


def test_duration_units():
    from gavel.functions.time import duration_ns
    assert duration_ns("250 milliseconds") == 250_000_000
    assert duration_ns("10 microseconds") == 10_000
    assert duration_ns("12h") == 12 * 3600 * 10**9
    assert duration_ns("1 day") == 86_400 * 10**9
    assert duration_ns(7) == 7


def test_timeline_default_slot(spark):
    df = spark.createDataFrame([(t * 100_000_000, 5) for t in range(10)], "t_ns long, latency_ns long")
    assert latency_timeline(df, width=1).count() == 4  # 250 ms slots over one second
