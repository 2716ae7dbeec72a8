"""Hot join keys: Spark splits their partitions, the rows stay the same, and
building a query runs no job."""

import pytest
from conftest import SF_SMALL
from oracle_util import _norm
from pyspark.sql import functions as F

from gavel.operators.closing import closed_auctions
from gavel.operators.joins import q3_local_items, q8_as_written, q8_new_users
from gavel.sources.tables import from_tpch

SPLIT_SOON = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture
def split_soon(spark):
    before = {k: spark.conf.get(k, None) for k in SPLIT_SOON}
    for k, v in SPLIT_SOON.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def final_plan(df):
    rows = _norm(df.toPandas())
    return df._jdf.queryExecution().executedPlan().toString(), rows


@pytest.fixture(scope="module")
def skewed(spark):
    """Half of all bids on one auction, half of all auctions by one seller (shared files, so the scan has many tasks)."""
    from stream_util import fresh
    n = 60_000
    folder = fresh("skew")
    spark.range(n).selectExpr(
        "CASE WHEN id % 2 = 0 THEN 7 ELSE id % 500 END AS auction", "id % 1000 AS bidder",
        "xxhash64(id) % 100000 AS price", "id AS date_time_ns").repartition(16).write.parquet(f"{folder}/bid")
    spark.range(n).selectExpr(
        "id", "'' AS item_name", "'' AS description", "0L AS initial_bid", "0L AS reserve", "0L AS date_time_ns",
        "1000000000L AS expires_ns", "CASE WHEN id % 2 = 0 THEN 3 ELSE id % 400 END AS seller", "10L AS category"
    ).repartition(16).write.parquet(f"{folder}/auction")
    spark.range(400).selectExpr("id", "'' AS name", "'' AS email_address", "'' AS credit_card", "'' AS city",
                                "'OR' AS state", "0L AS date_time_ns").write.parquet(f"{folder}/person")
    return {x: spark.read.parquet(f"{folder}/{x}") for x in ("bid", "auction", "person")}


def test_closed_auctions_splits_a_hot_auction(spark, skewed, split_soon):
    plan, rows = final_plan(closed_auctions(skewed["auction"], skewed["bid"]))
    assert "skew=true" in plan
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
    try:
        plain, want = final_plan(closed_auctions(skewed["auction"], skewed["bid"]))
    finally:
        spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    assert "skew=true" not in plain and rows.equals(want) and len(rows) == 250


def test_q8_splits_a_hot_seller(spark, skewed, split_soon):
    plan, rows = final_plan(q8_new_users(skewed["person"], skewed["auction"]).groupBy("id").agg(F.count("*").alias("n")))
    assert "skew=true" in plan
    assert dict(zip(rows["id"], rows["n"]))[3] == 30_000 + 150 and rows["n"].sum() == 60_000


def test_building_a_query_runs_no_job(spark):
    t = from_tpch(spark, SF_SMALL)
    sc = spark.sparkContext
    sc.setJobGroup("building", "building")
    try:
        closed_auctions(t.auction, t.bid)
        q3_local_items(t.auction, t.person)
        q8_new_users(t.person, t.auction)
        q8_as_written(t.auction)
        assert list(sc.statusTracker().getJobIdsForGroup("building")) == []
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
