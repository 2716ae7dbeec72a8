"""Partition independence, state-provider parity and plan shape."""

import pytest
from conftest import SF_SMALL
from oracle_util import _norm
from stream_util import fresh

import __spark_entry__ as entry
from gavel.operators.latency import latency_ccdf, samples_from_events
from gavel.plans import QUERIES
from gavel.sources.sinks import report_lines, write_report
from gavel.operators.windows import q5_hot_items, q5_hot_items_by_window
from gavel.sources.tables import dense_bids, read_table
from gavel.streaming.sources import ROCKSDB, state_store


@pytest.mark.parametrize("name", ["closed_auctions", "q4_running_avg", "q6_last10_bidder",
                                  "q5_hot_items_panes", "q8_new_users_30d"])
def test_partition_independent(spark, name):
    results = []
    for p in (1, 2, 7):
        spark.conf.set("spark.sql.shuffle.partitions", str(p))
        results.append(_norm(QUERIES[name](spark, SF_SMALL).toPandas()))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0].equals(results[1]) and results[0].equals(results[2])


def test_closed_auctions_plan_has_one_exchange_per_side(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES["closed_auctions"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2
    assert "SortMergeJoin" in plan


def test_scan_is_pruned(spark):
    plan = QUERIES["q2_selection"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double>" in plan


def test_report_lines(spark):
    df = latency_ccdf(samples_from_events(read_table(spark, SF_SMALL, "events")), width=100)
    first = report_lines(df, "latency_ccdf", ["latency"]).first()["value"].split("\t")
    assert first[0] == "latency_ccdf" and float(first[2]) == 1.0
    out = fresh("report")
    write_report(df, out + "/r", "latency_ccdf", ["latency"])
    assert spark.read.text(out + "/r").count() == df.count()


def test_state_provider_parity(spark):
    """Built-in streaming aggregation: default and RocksDB state stores agree."""
    from gavel.sources.generator import GeneratorConfig, generate_events
    from gavel.streaming.queries import q7_stream
    from gavel.streaming.sources import event_file_stream, timed_events, timed_tables
    from stream_util import run_to_memory, write_ordered_event_files
    cfg = GeneratorConfig(base_time_ns=1_700_000_000 * 10**9)
    folder = write_ordered_event_files(spark, generate_events(spark, 4000, cfg), 3, 1_800_000_000 * 10**9)
    out = []
    for i, provider in enumerate(["org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider",
                                  ROCKSDB]):
        t = timed_tables(timed_events(event_file_stream(spark, folder, 1)))
        out.append(_norm(run_to_memory(q7_stream(t.bid, "1 second"), f"parity{i}", provider=provider).toPandas()))
    assert len(out[0]) >= 4 and out[0].equals(out[1])


def test_entry_contract():
    assert set(entry.queries()) >= set(entry.oracle_sql()) >= set(QUERIES)


def test_hot_items_counts_before_it_fans_out(spark):
    plan = QUERIES["q5_hot_items"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and plan.index("Generate explode") < plan.rindex("HashAggregate")


@pytest.mark.parametrize("form", [q5_hot_items, q5_hot_items_by_window])
@pytest.mark.parametrize("size, slide", [("5 seconds", "2 seconds"), (3000, 1500), (0, 1000)])
def test_hot_items_rejects_uneven_windows(spark, form, size, slide):
    with pytest.raises(ValueError):
        form(dense_bids(spark, SF_SMALL), size, slide)


def test_state_store_is_given_back(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    with state_store(spark, ROCKSDB):
        assert spark.conf.get(key) == ROCKSDB
    assert spark.conf.get(key, None) == before
