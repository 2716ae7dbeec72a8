"""Event JSON form, warm-up trim, and the rate-micro-batch feed."""

import json
import time

import pytest
from oracle_util import _norm
from stream_util import fresh

from gavel.operators.latency import trim
from gavel.sources.events import events_from_json, events_to_json, flatten
from gavel.sources.generator import GeneratorConfig, generate_events
from gavel.streaming.sources import generated_event_stream


def test_json_is_internally_tagged(spark):
    ev = generate_events(spark, 50).orderBy("arrival")
    lines = [json.loads(r.value) for r in events_to_json(ev).collect()]
    assert lines[0]["type"] == "Person" and set(lines[0]) == {
        "type", "id", "name", "email_address", "credit_card", "city", "state", "date_time"}
    assert lines[1]["type"] == "Auction" and "expires" in lines[1] and "reserve" in lines[1]
    assert lines[4] == {"type": "Bid", "auction": lines[4]["auction"], "bidder": lines[4]["bidder"],
                        "price": lines[4]["price"], "date_time": 4_000_000}
    back = flatten(events_from_json(events_to_json(ev)))
    assert _norm(back.toPandas()).equals(_norm(flatten(ev.drop("arrival", "time_ns")).toPandas()))


BAD_LINES = ['{"type":"Bid","auction":1,"bidder":2,"pri', '{"type":"Bid","auction":"x","bidder":2,"price":3,"date_time":4}',
             '{"type":"Offer","auction":1}', "{}", None]


def test_bad_json_lines_are_kept_and_counted(spark):
    good = '{"type":"Bid","auction":1,"bidder":2,"price":3,"date_time":4}'
    lines = spark.createDataFrame([(x,) for x in [good, *BAD_LINES]], "value string")
    got = events_from_json(lines, bad="keep").collect()
    assert sorted(r.bad_line or "" for r in got if r.bad_line is not None) == sorted(x or "" for x in BAD_LINES)
    (event,) = [r for r in got if r.bad_line is None]
    assert event.type == "Bid" and event.bid.price == 3
    assert all(r.type is None and r.person is None and r.auction is None and r.bid is None for r in got if r.bad_line is not None)


@pytest.mark.parametrize("line", BAD_LINES)
def test_bad_json_lines_fail_by_default(spark, line):
    with pytest.raises(Exception, match="(?i)malformed|unknown event type"):
        events_from_json(spark.createDataFrame([(line,)], "value string")).collect()


def test_unknown_types_are_not_written_as_bids(spark):
    from gavel.schema import EVENT
    for kind in ("Offer", None):
        with pytest.raises(Exception, match="unknown event type"):
            events_to_json(spark.createDataFrame([(kind, None, None, None)], EVENT)).collect()


def test_trim_keeps_steady_part(spark):
    df = spark.createDataFrame([(t * 10**9, 1) for t in range(31)], "t_ns long, latency_ns long")
    kept = sorted(r.t_ns // 10**9 for r in trim(df, 0, 30 * 10**9).collect())
    assert kept == list(range(2, 28))


def test_rate_feed_matches_batch_generation(spark):
    cfg = GeneratorConfig(base_time_ns=1_700_000_000 * 10**9)
    stream = generated_event_stream(spark, rows_per_batch=500, cfg=cfg, num_partitions=3)
    q = (stream.writeStream.format("memory").queryName("rate_feed")
         .option("checkpointLocation", fresh("rate")).trigger(processingTime="200 milliseconds").start())
    deadline = time.time() + 120
    while time.time() < deadline and (q.lastProgress is None or q.lastProgress["batchId"] < 2):
        time.sleep(0.2)
    q.stop()
    got = spark.table("rate_feed")
    n = got.count()
    assert n >= 1000 and n % 500 == 0
    want = generate_events(spark, n, cfg)
    assert _norm(flatten(got.drop("arrival", "time_ns")).toPandas()).equals(
        _norm(flatten(want.drop("arrival", "time_ns")).toPandas()))


def test_json_lines_stream(spark):
    """The JSON wire form as a streaming source (text lines -> events -> Q1)."""
    from gavel.operators.basic import q1_currency
    from gavel.sources.events import demux
    from gavel.streaming.sources import timed_events, timed_tables
    from stream_util import run_to_memory
    ev = generate_events(spark, 2000, GeneratorConfig(base_time_ns=1_700_000_000 * 10**9))
    folder = fresh("jsonl")
    events_to_json(ev).coalesce(2).write.text(folder + "/in")
    lines = spark.readStream.format("text").load(folder + "/in")
    t = timed_tables(timed_events(events_from_json(lines)))
    got = run_to_memory(q1_currency(t.bid), "json_q1")
    want = q1_currency(demux(ev).bid)
    assert _norm(got.toPandas()).equals(_norm(want.toPandas()))


def test_progress_samples(spark):
    from gavel.operators.latency import latency_ccdf
    from gavel.streaming.progress import progress_samples
    stream = generated_event_stream(spark, rows_per_batch=100, cfg=GeneratorConfig(base_time_ns=10**18))
    q = (stream.writeStream.format("noop").option("checkpointLocation", fresh("prog"))
         .trigger(processingTime="100 milliseconds").start())
    deadline = time.time() + 60
    while time.time() < deadline and len(q.recentProgress) < 3:
        time.sleep(0.2)
    samples = progress_samples(spark, q)
    q.stop()
    rows = samples.collect()
    assert all(r.rows == 100 for r in rows)
    assert len(rows) >= 3 and all(r.latency_ns >= 0 and r.t_ns > 0 for r in rows)
    assert latency_ccdf(samples, sig_bits=3).count() >= 1


def test_run_named_writes_reports(spark):
    from gavel.streaming.run import run_named
    out = fresh("runs")
    ccdf, timeline = run_named(spark, "q3_mem", rate=20_000, duration="4 seconds", out_dir=out,
                               trigger="500 milliseconds", min_batches=2, warmup="0 seconds", cooldown="0 seconds")
    lines = [r.value for r in spark.read.text(f"{out}/q3_mem/latency_ccdf").collect()]
    assert lines and all(x.startswith("latency_ccdf\t") for x in lines)
    assert max(float(x.split("\t")[2]) for x in lines) == 1.0
    tl = [r.value for r in spark.read.text(f"{out}/q3_mem/summary_timeline").collect()]
    assert tl and all(x.startswith("summary_timeline\t") for x in tl)
