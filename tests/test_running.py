"""running_frame against a brute-force pandas computation, with keys that
span many partitions (one key holds most rows)."""

import numpy as np
import pandas as pd
import pytest

from gavel.operators.running import running_frame


def brute(pdf, last_k):
    pdf = pdf.sort_values(["k", "t", "id"]).reset_index(drop=True)
    g = pdf.groupby("k")["v"]
    if last_k is None:
        s, c = g.cumsum(), g.cumcount() + 1
    else:
        s = g.transform(lambda x: x.rolling(last_k, min_periods=1).sum()).astype("int64")
        c = np.minimum(g.cumcount() + 1, last_k)
    pdf["frame_sum"], pdf["frame_count"] = s.astype("int64"), c.astype("int64")
    return pdf


@pytest.mark.parametrize("last_k", [None, 1, 3, 10])
@pytest.mark.parametrize("parts", [1, 3, 7])
def test_running_frame_matches_brute_force(spark, last_k, parts):
    rng = np.random.default_rng(5)
    n = 3000
    keys = np.where(rng.random(n) < 0.6, 0, rng.integers(1, 40, n))  # key 0 is hot
    pdf = pd.DataFrame({"k": keys.astype("int64"), "t": rng.integers(0, 500, n).astype("int64"),
                        "id": np.arange(n, dtype="int64"), "v": rng.integers(1, 10**8, n).astype("int64")})
    df = spark.createDataFrame(pdf)
    got = running_frame(df, ["k"], ["t", "id"], "v", last_k=last_k, num_partitions=parts).toPandas()
    got = got.sort_values(["k", "t", "id"]).reset_index(drop=True)
    want = brute(pdf, last_k)
    assert (got[["frame_sum", "frame_count"]].to_numpy() == want[["frame_sum", "frame_count"]].to_numpy()).all()


def test_running_frame_string_key_and_empty_partitions(spark):
    pdf = pd.DataFrame({"k": ["a"] * 5 + ["b"] * 2, "t": [5, 4, 3, 2, 1, 1, 2], "id": list(range(7)),
                        "v": [1, 2, 3, 4, 5, 6, 7]})
    got = running_frame(spark.createDataFrame(pdf), ["k"], ["t", "id"], "v", last_k=2,
                        num_partitions=16).toPandas().sort_values(["k", "t"])
    assert got["frame_sum"].tolist() == [5, 9, 7, 5, 3, 6, 13]


def window_form(df, last_k):
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    start = Window.unboundedPreceding if last_k is None else 1 - last_k
    w = Window.partitionBy("k").orderBy("t", "id").rowsBetween(start, 0)
    return df.withColumns({"frame_sum": F.sum("v").over(w), "frame_count": F.count("v").over(w)})


@pytest.mark.parametrize("last_k", [None, 1, 2, 4])
def test_running_frame_agrees_with_the_window_on_nulls_and_wide_keys(spark, last_k):
    wide = 2**53
    rows = [(k, t, 10 * t + i, v) for i, (k, v) in enumerate([(None, 1), (None, None), (wide, 5), (wide + 1, 7), (1, None)])
            for t in range(6)] + [(2, 0, 99, None), (2, 1, 100, None), (2, 2, 101, 3)]
    df = spark.createDataFrame(rows, "k long, t long, id long, v long")
    for parts in (1, 4, 9):
        got = running_frame(df, ["k"], ["t", "id"], "v", last_k=last_k, num_partitions=parts)
        assert sorted(map(str, got.collect())) == sorted(map(str, window_form(df, last_k).collect()))


@pytest.mark.parametrize("last_k", [None, 3])
def test_running_frame_raises_on_overflow(spark, last_k):
    df = spark.createDataFrame([(1, t, t, 2**62) for t in range(4)], "k long, t long, id long, v long")
    for parts in (1, 3):
        with pytest.raises(Exception, match="(?i)overflow"):
            running_frame(df, ["k"], ["t", "id"], "v", last_k=last_k, num_partitions=parts).collect()


def test_running_frame_leaves_the_callers_cache_and_runs_no_python(spark):
    df = spark.range(100).selectExpr("id % 3 AS k", "id AS t", "id", "id AS v").persist()
    try:
        df.count()
        got = running_frame(df, ["k"], ["t", "id"], "v")
        assert got.count() == 100 and df.storageLevel.useMemory
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    finally:
        df.unpersist()
