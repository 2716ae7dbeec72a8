"""Live features: session closing, ordered replay, fan-out, upserts, stream equality, late rows, as-of join."""

import random

import pytest
from helpers import auctions, bids, persons
from oracle_util import _norm
from pyspark.errors import StreamingQueryException
from pyspark.sql import Window
from pyspark.sql import functions as F
from stream_util import fresh, run_to_memory
from test_streaming import BASE, CFG, N, auction_event, bid_event, feed, write_feed  # noqa: F401 (feed is a fixture)

from gavel.operators.asof import latest_before, q3_latest_registration
from gavel.operators.averages import q4_category_avg, q4_running_avg, q6_last_avg
from gavel.operators.closing import closed_auctions
from gavel.operators.joins import q3_local_items, q8_as_written
from gavel.operators.latency import latency_ccdf, latency_timeline
from gavel.operators.windows import q5_hot_items, q5_hot_items_deltas
from gavel.plans import streams as P
from gavel.sources.events import demux, to_events
from gavel.sources.files import numbered, part_files
from gavel.sources.generator import GeneratorConfig, generate_events
from gavel.sources.tables import TABLE_SCHEMAS, AuctionTables, auction_from_orders, dense_bids, from_tpch
from gavel.streaming import queries as S
from gavel.streaming import replay as R
from gavel.streaming.closing import closed_auctions_sessions, hot_auctions, session_rows
from gavel.streaming.diff import diff_stream
from gavel.streaming.fanout import fan_out, table_sink
from gavel.streaming.frames import means_sink
from gavel.streaming.packs import packed
from gavel.streaming.replay import STRIDE, write_replay
from gavel.streaming.sources import SHARD_ROWS, event_file_stream, state_shards, state_store
from gavel.streaming.upserts import KeyedLog

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def same(a, b):
    pa, pb = _norm(a.toPandas()), _norm(b.toPandas())
    return pa.equals(pb) and len(pa) > 0


# Closing by session windows


@pytest.mark.parametrize("salts", [1, 3])
def test_sessions_close_as_the_join_does(spark, salts):
    """Thousands of small auctions with bids on, beside and around both ends, ties and bids in neighbouring ns."""
    draw = random.Random(5)
    made = [dict(id=i, t=(t := draw.randrange(50, 60)), exp=t + draw.randrange(0, 6), reserve=draw.randrange(0, 6)) for i in range(3000)]
    offers = [(a["id"], draw.randrange(3), draw.randrange(8), draw.randrange(a["t"] - 2, a["exp"] + 3)) for a in made for _ in range(draw.randrange(9))]
    offers += [(10**6, 1, 5, 55), (None, 1, 5, 55), (7, 1, None, 55), (8, None, 4, 55), (9, 1, 4, None)]
    a, b = auctions(spark, made), bids(spark, offers)
    events = to_events(AuctionTables(persons(spark, []), a, b))
    want = closed_auctions(a, b)
    assert same(closed_auctions_sessions(events, salts=salts), want)


def test_live_sessions(spark, feed):
    events, folder = feed
    b = demux(events)
    got = run_to_memory(closed_auctions_sessions(event_file_stream(spark, folder, 1)), "s_sessions")
    assert same(got, closed_auctions(b.auction, b.bid))
    # without Python
    plan = closed_auctions_sessions(events)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_live_sessions_with_disorder(spark):
    events = generate_events(spark, N, GeneratorConfig(out_of_order_group_size=10, base_time_ns=BASE))
    b = demux(events)
    at = F.coalesce("person.date_time_ns", "auction.date_time_ns", "bid.date_time_ns")
    feed = write_replay(events.withColumn("at", F.col("arrival")).drop("arrival"), fresh("dis") + "/feed", "at", 6).stream(spark)
    got = P.run_to_table(closed_auctions_sessions(feed, "20 milliseconds"))
    last = events.select(F.max(at)).first()[0] - 20_000_000
    want = closed_auctions(b.auction, b.bid).where(3 * F.col("expires_ns") - 1 <= F.lit((3 * last + 1) // 1000 * 1000))
    assert same(got, want)


def test_early_bids_and_late_auctions(spark):
    folder = write_feed(spark, [
        [bid_event(1, 30, 5), bid_event(1, 40, 6), bid_event(2, 70, 3)],  # both auctions unknown yet
        [auction_event(1, 4, 50), bid_event(9, 1, 4)],  # auction 1 takes its early bids
        [bid_event(1, 35, 20), bid_event(9, 1, 30)],
        [auction_event(2, 40, 60), bid_event(2, 5, 45)],  # the bid at 3 s came before auction 2 began
        [bid_event(9, 1, 1000)], [bid_event(9, 1, 1001)]])
    got = run_to_memory(closed_auctions_sessions(event_file_stream(spark, folder, 1), "3 seconds"), "s_early_sessions").collect()
    assert {r.auction: r.price for r in got} == {1: 40, 2: 5}


def test_a_hot_auction_is_many_tasks(spark):
    """Half of all bids on one auction: with salts no task has over twice the median's rows, and the winners are the same."""
    n = 20_000
    a = auctions(spark, [dict(id=i, t=0, exp=10**9) for i in range(500)])
    b = bids(spark, [(0 if i % 2 else i % 499 + 1, i % 7, i * 7919 % 10_007, i) for i in range(n)])
    events = to_events(AuctionTables(persons(spark, []), a, b))

    def sizes(salts):
        dealt = session_rows(events, salts).repartition(8, "id", "salt").where("b IS NOT NULL")
        return sorted(r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect())
    assert max(sizes(1)) > 5 * sizes(1)[3]
    assert max(sizes(64)) <= 2 * sizes(64)[3]
    assert same(closed_auctions_sessions(events, salts=64), closed_auctions(a, b))


def test_only_hot_auctions_are_salted(spark):
    """An auction that isn't hot is one row of state, and the winners are the same whichever ids are salted."""
    n = 60_000
    a = auctions(spark, [dict(id=i, t=0, exp=10**9, reserve=i % 50) for i in range(500)])
    b = bids(spark, [(7 if i % 3 else i % 499, i % 7, i * 7919 % 10_007, i) for i in range(n)])
    events = to_events(AuctionTables(persons(spark, []), a, b))
    hot = hot_auctions(b, n, 8)
    assert hot == [7]
    made = {r.id: r["count"] for r in session_rows(events, 16, hot).where("a IS NOT NULL").groupBy("id").count().collect()}
    assert made == {i: 16 if i == 7 else 1 for i in range(500)}
    want = rows(closed_auctions(a, b))
    for ids in ([], hot, [7, 8, 10**6]):
        assert rows(closed_auctions_sessions(events, salts=16, hot=ids)) == want and len(want) > 400


# Closing by blocks


def _closing_feed(draw, batches=6, per_batch=400):
    """Auctions of repeated, overlapping and null ids, bids early, late and on the edges, nulls everywhere, in no time order."""
    feed = []
    for k in range(batches):
        made = []
        for _ in range(per_batch):
            at = k * 20 + draw.randrange(-25, 40)
            id_ = draw.choice([None, 10**6] if draw.random() < 0.02 else range(60))
            if draw.random() < 0.25:
                times = BASE + at * 10**9, BASE + (at + draw.randrange(-1, 30)) * 10**9
                made.append(("Auction", None, (id_, "", "", 0, draw.choice([None, 0, 3, 5, 7]), draw.choice([None, times[0], *[times[0]] * 20]),
                                               draw.choice([None, *[times[1]] * 20]), draw.choice([None, 1, 2]), draw.choice([None, 10, 11])), None))
            else:
                made.append(("Bid", None, None, (id_, draw.choice([None, 1, 2, 3]), draw.choice([None, *range(9)]),
                                                 draw.choice([None, *[BASE + at * 10**9 + draw.randrange(-1, 2)] * 20]))))
        feed.append(made)
    return feed + [[bid_event(10**7, 1, 10**5)], [bid_event(10**7, 1, 10**5 + 1)]]


@pytest.mark.parametrize("seed, delay, hot", [(1, "0 seconds", []), (2, "15 seconds", [3, 7]), (3, "40 seconds", [5])])
def test_blocks_close_as_sessions_do(spark, seed, delay, hot):
    """Closing by blocks gives the rows of Spark's session windows: late rows, repeated ids, nulls and salts."""
    folder = write_feed(spark, _closing_feed(random.Random(seed)))
    read = lambda: event_file_stream(spark, folder, 1)
    want = rows(P.run_to_table(closed_auctions_sessions(read(), delay, 4, hot)))
    assert rows(P.run_to_table(closed_auctions_sessions(read(), delay, 4, hot, per_batch=1000))) == want and len(want) > 20


@pytest.mark.parametrize("seed, delay, hot", [(4, "0 seconds", []), (5, "15 seconds", [3, 7])])
def test_bounded_blocks_close_as_the_join_does(spark, seed, delay, hot):
    """Bounded closing by blocks gives the rows of the stream-stream join, to the millisecond of the watermark."""
    feed = []
    for made in _closing_feed(random.Random(seed)):
        # Of two auctions of one id that close in the same ms either may be named; here they are alike.
        feed.append([(k, p, a and (a[0], "", "", 0, a[4], a[5], a[6], 1, 10), b) for k, p, a, b in made])
    for shift in (3, 4):
        # The last auction sets the watermark: 31 s of bound, and its close, decide what leaves.
        last = [auction_event(10**7, 10**3, 10**3 + 1), bid_event(10**7, 1, 120)]
        last = [last[0], (*last[1][:3], (*last[1][3][:3], BASE + 120 * 10**9 + shift * 10**6))]
        folder = write_feed(spark, feed[:-2] + [last, [bid_event(10**7, 1, 120)]])
        read = lambda: event_file_stream(spark, folder, 1)
        want = rows(P.run_to_table(S.closed_auctions_stream_bounded(read(), "31 seconds", delay)))
        assert rows(P.run_to_table(S.closed_auctions_stream_bounded(read(), "31 seconds", delay, 1000, 4, hot))) == want and len(want) > 20


def test_registered_closing_keeps_blocks_in_state(spark, monkeypatch):
    """The state's rows are blocks of auctions, not auctions and bids; a row each, for all of the micro-batch's rows."""
    seen, finished = [], P.finished
    monkeypatch.setattr(P, "finished", lambda *a, **k: seen.append(finished(*a, **k)) or seen[-1])
    assert P.STREAM_QUERIES["q6_stream"](spark, SF).count() > 0
    first = seen[0].recentProgress[0]
    assert first["numInputRows"] > 5000
    assert 0 < sum(op["numRowsUpdated"] for op in first["stateOperators"]) < 200


# Shards of state


def test_state_is_sharded_by_the_rows_of_a_micro_batch(spark, monkeypatch):
    key, cores = "spark.sql.shuffle.partitions", spark.sparkContext.defaultParallelism
    before, seen = spark.conf.get(key), []
    finished = P.finished
    monkeypatch.setattr(P, "finished", lambda *a, **k: seen.append(finished(*a, **k)) or seen[-1])
    spark.conf.set(key, "64")
    try:
        assert state_shards(spark, 0) == state_shards(spark, SHARD_ROWS * cores) == min(64, cores)
        assert state_shards(spark, SHARD_ROWS * cores + 1) == min(64, 2 * cores) and state_shards(spark, 10**12) == 64
        P.STREAM_QUERIES["q7_stream"](spark, SF).count()
        assert spark.conf.get(key) == "64"
        assert {op["numShufflePartitions"] for p in seen[0].recentProgress for op in p["stateOperators"]} == {min(64, cores)}
    finally:
        spark.conf.set(key, before)


def test_the_second_query_takes_a_batch_of_the_first_at_once(spark, monkeypatch):
    """Q4 in update mode: its micro-batches don't grow with the files of the closings."""
    key = "spark.sql.shuffle.partitions"
    before, seen = spark.conf.get(key), []
    finished = P.finished
    monkeypatch.setattr(P, "finished", lambda *a, **k: seen.append(finished(*a, **k)) or seen[-1])
    monkeypatch.setattr(P, "state_shards", lambda *a: 30)
    spark.conf.set(key, "30")
    try:
        got = P.q4_update(spark, "/root/testdata/sf0.01")
        first, second = ([p for p in q.recentProgress if p["numInputRows"]] for q in seen)
        assert len(first) == P.SHARED_BATCHES and len(second) <= P.SHARED_BATCHES + 1
        assert got.count() == 5
    finally:
        spark.conf.set(key, before)


def test_q8_as_written_keeps_packs_in_state(spark, monkeypatch):
    """Packs of auctions are the state's rows; repeated ids, a hot seller of several packs and nulls give the pairs of the batch form."""
    folder, seen = fresh("orders"), []
    n = 6000
    (spark.range(n).selectExpr(
        "IF(id % 50 = 1, NULL, id % 2000) AS o_orderkey",
        "CASE WHEN id % 41 = 0 THEN NULL WHEN id % 3 = 0 THEN 7 ELSE id % 900 END AS o_custkey",
        "'O' AS o_orderstatus", "CAST(id AS DOUBLE) AS o_totalprice",
        "IF(id % 37 = 0, NULL, TIMESTAMP_NTZ'1995-01-01 00:00:00' + make_dt_interval(0, CAST(id * 7919 % 400 AS INT))) AS o_orderdate",
        "'1' AS o_orderpriority").repartition(3).write.parquet(f"{folder}/orders.parquet"))
    for name in ("customer", "lineitem"):
        spark.createDataFrame([], TABLE_SCHEMAS[name]).write.parquet(f"{folder}/{name}.parquet")
    want = rows(q8_as_written(from_tpch(spark, folder).auction, "12 hours"))
    finished = P.finished
    monkeypatch.setattr(P, "finished", lambda *a, **k: seen.append(finished(*a, **k)) or seen[-1])
    assert rows(P.STREAM_QUERIES["q8_as_written_stream"](spark, folder)) == want and len(want) > n // 2
    assert 0 < sum(op["numRowsUpdated"] for p in seen[0].recentProgress for op in p["stateOperators"]) < n // 8
    # Several micro-batches in no time order: rows of one meet those of another.
    orders = spark.readStream.schema(TABLE_SCHEMAS["orders"]).option("maxFilesPerTrigger", 1).parquet(f"{folder}/orders.parquet")
    assert rows(P.run_to_table(S.q8_as_written_stream(P.timed(auction_from_orders(orders)), "12 hours", n // 3), n)) == want
    assert len([p for p in seen[1].recentProgress if p["numInputRows"]]) == 3


@pytest.mark.parametrize("chunk, largest", [(1, 1024), (7, 2), (10**6, 3)])
def test_packs_hold_every_row_once(spark, chunk, largest):
    df = spark.range(200).selectExpr("id % 5 AS k", "IF(id % 9 = 0, NULL, id) AS v")
    got = packed(df, "k", 3, 200, chunk, largest)
    assert got.where(F.size("k") > largest).isEmpty() and got.where("size(k) != size(v) OR block NOT BETWEEN 0 AND 2").isEmpty()
    assert rows(got.select(F.inline(F.arrays_zip("k", "v")))) == rows(df)
    assert got.select("block", F.explode("k").alias("k")).distinct().count() == 5


# Ordered replay


def test_replay_comes_in_time_order_and_evicts(spark):
    table = P.auction_events(spark, SF)
    feed = write_replay(table, fresh("replay") + "/feed", "date_time_ns", 20)
    files = part_files(spark, feed.folder)
    ends = [spark.read.parquet(f).agg(F.min("date_time_ns"), F.max("date_time_ns"), F.count("*")).first() for f in files]
    assert len(files) == 20 and sum(e[2] for e in ends) == feed.rows == table.count()
    assert all(x[1] <= y[0] for x, y in zip(ends, ends[1:])) and {e[2] for e in ends[:-1]} == {feed.rows_per_file}
    assert same(spark.read.parquet(feed.folder), table)
    folder = P.fresh_folder(spark)
    query = P.finished(P.into(closed_auctions_sessions(feed.stream(spark)), folder), folder)
    progress = [p for p in query.recentProgress if p["numInputRows"]]
    assert [p["numInputRows"] for p in progress] == [e[2] for e in ends]  # each row once, a file a batch
    ops = [[op for op in p["stateOperators"]] for p in query.recentProgress]
    assert sum(op["numRowsRemoved"] for p in ops for op in p) > feed.rows / 2  # evicted meanwhile
    assert ops[-1][-1]["numRowsTotal"] < feed.rows / 10


def test_replay_in_order_numbers_no_rows(spark, monkeypatch):
    """The cuts are exact whichever keys repeat, and rows in time order are neither numbered nor checkpointed."""
    draw = random.Random(2)
    made = [(draw.randrange(40), draw.randrange(10**6)) for _ in range(3000)]
    made += [made[0]] * 2000
    ranks = [1, 2, 1000, 2500, len(made) - 1, len(made)]
    monkeypatch.setattr(R, "SUMMARY", 16)
    assert R.keys_at(spark.createDataFrame(made, "t long, tie long").repartition(5), ranks) == [sorted(made)[r - 1] for r in ranks]
    monkeypatch.setattr(R, "running_frame", lambda *a, **k: pytest.fail("numbered"))
    feed = write_replay(spark.range(100), fresh("plain") + "/feed", "id", 5, files_per_batch=2)
    assert [len(spark.read.parquet(f).collect()) for f in part_files(spark, feed.folder)] == [10] * 10


@pytest.mark.parametrize("disorder", [1, 7, 100, 954])
def test_bounded_disorder(spark, disorder):
    n = 1000
    df = spark.range(n).select((F.col("id") * 10).alias("t"), (F.col("id") % 3).alias("x"))
    feed = write_replay(df, fresh("disorder") + "/feed", "t", 10, files_per_batch=2, disorder=disorder)
    got = [r.t // 10 for f in part_files(spark, feed.folder) for r in spark.read.parquet(f).collect()]
    whole = n // disorder * disorder
    assert got == [k // disorder * disorder + k * STRIDE % disorder if k < whole and disorder > 1 else k for k in range(n)]


def test_disorder_needs_a_coprime_group(spark):
    with pytest.raises(ValueError, match="factor"):
        write_replay(spark.range(3), fresh("bad") + "/feed", "id", 2, disorder=2 * STRIDE)


def test_replay_of_odd_tables(spark):
    empty = spark.range(0)
    assert write_replay(empty, fresh("none") + "/feed", "id", 5).rows == 0
    same_time = spark.range(50).select(F.lit(7).cast("long").alias("t"), "id").unionByName(spark.createDataFrame([(None, 1), (7, 3)], "t long, id long"))
    feed = write_replay(same_time, fresh("ties") + "/feed", "t", 100)
    assert rows(spark.read.parquet(feed.folder)) == rows(same_time)


# Fan-out and upserts


def test_one_read_and_one_closing_feed_several_means(spark, feed):
    events, folder = feed
    b = demux(events)
    batch = closed_auctions(b.auction, b.bid)
    out = fresh("fan")
    sinks = {"q4": means_sink(spark, out + "/q4", out + "/q4-state", every=2), "q6": means_sink(spark, out + "/q6", out + "/q6-state", "bidder", 10, every=2),
             "closed": table_sink(out + "/closed"), "dear": table_sink(out + "/dear", lambda x: x.where("price > 1000").select("auction"))}
    query = P.finished(fan_out(closed_auctions_sessions(event_file_stream(spark, folder, 1)), sinks), out)
    assert same(spark.read.parquet(out + "/q4").drop("batch"), q4_running_avg(batch))
    assert same(spark.read.parquet(out + "/q6").drop("batch"), q6_last_avg(batch))
    assert same(spark.read.parquet(out + "/closed").drop("batch"), batch)
    assert same(spark.read.parquet(out + "/dear").drop("batch"), batch.where("price > 1000").select("auction"))
    assert sum(p["numInputRows"] for p in query.recentProgress) == spark.read.parquet(folder).count()
    assert len(numbered(spark, out + "/q4-state/changes")) <= 4  # what no replay needs is gone


def test_a_failed_sink_runs_again_without_harm(spark, feed):
    events, folder = feed
    b = demux(events)
    out, failed = fresh("retry"), []

    def once(batch, batch_id):
        if batch_id == 2 and not failed:
            failed.append(batch_id)
            raise RuntimeError("lost")
    sinks = {"q4": means_sink(spark, out + "/q4", out + "/q4-state", every=3), "bad": once}
    for _ in range(2):
        try:
            P.finished(fan_out(closed_auctions_sessions(event_file_stream(spark, folder, 1)), sinks), out)
        except StreamingQueryException:
            assert failed
    assert same(spark.read.parquet(out + "/q4").drop("batch"), q4_running_avg(closed_auctions(b.auction, b.bid)))


@pytest.mark.parametrize("every", [1, 2, 5])
def test_keyed_log_is_a_dictionary(spark, every):
    draw, want, history = random.Random(every), {}, []
    log = KeyedLog(spark, fresh("log"), "k long, tag string, v long", ["k", "tag"], every)
    for batch_id in range(7):
        assert rows(log.before(batch_id)) == sorted(((k, t, v) for (k, t), v in want.items()), key=str)
        new = {(draw.choice([None, 1, 2, 3, 4]), draw.choice(["a", None])): draw.choice([None, batch_id]) for _ in range(draw.randrange(4))}
        for _ in range(1 + batch_id % 2):  # some batches run twice
            log.put(spark.createDataFrame([(k, t, v) for (k, t), v in new.items()], "k long, tag string, v long"), batch_id)
        want |= new
        history.append(new)
    assert rows(log.table()) == sorted(((k, t, v) for (k, t), v in want.items()), key=str)


def test_q4_in_update_mode(spark, feed):
    events, folder = feed
    b = demux(events)
    closed = P.run_to_table(closed_auctions_sessions(event_file_stream(spark, folder, 1)))
    out = fresh("q4u")
    closed.repartition(5).write.parquet(out + "/closed")
    stream = spark.readStream.schema(closed.schema).option("maxFilesPerTrigger", 1).parquet(out + "/closed")
    log = KeyedLog(spark, out + "/q4", "category long, avg_price long", ["category"], every=2)
    query = P.finished(S.q4_category_avg_stream(stream).writeStream.outputMode("update").foreachBatch(log.put), out)
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 5
    assert same(log.table(), q4_category_avg(closed_auctions(b.auction, b.bid)))


def test_all_names_run_together(spark):
    """The 35 names at once: names without state share one query, q4 and q6 one closing for each state store, and
    all state stores give the same rows."""
    from gavel.streaming.named import NAMES, parse, start_together
    events = generate_events(spark, 3000, CFG)
    columns = ["type", "person", "auction", "bid"]
    folder = fresh("names")
    at = F.coalesce("person.date_time_ns", "auction.date_time_ns", "bid.date_time_ns")
    feed = write_replay(events.select(*columns, at.alias("at")), folder + "/feed", "at", 2)
    started = start_together(spark, NAMES, feed.stream(spark).select(*columns), folder + "/out", available_now=True)
    for q in set(started.values()):
        q.awaitTermination()
    assert set(started) == set(NAMES) and len(NAMES) == 35
    assert started["q0"] is started["q2"] and started["q4"] is started["q6_rocksdb"] and started["q4"] is not started["q4_mem"]
    counts = {}
    for name in NAMES:
        counts.setdefault(parse(name)[0], set()).add(spark.read.parquet(f"{folder}/out/{name}").drop("batch").count())
    b = demux(events)
    assert counts["q0"] == {3000} and counts["q1"] == {b.bid.count()} and counts["q3"] == {q3_local_items(b.auction, b.person).count()}
    assert counts["q4"] == counts["q6"] and all(len(c) == 1 for c in counts.values()), counts
    assert min(counts["q4"]) > 0 and min(counts["q8"]) > 0


# Stream equality, late rows


def test_a_difference_fails_the_query(spark):
    bids_ = P.replayed(dense_bids(spark, SF), batches=3)
    left = S.q7_stream(P.timed(bids_), "1 hour", timed=True)
    right = S.q7_stream(P.timed(bids_), "1 hour", timed=True)
    assert P.run_to_table(diff_stream(left, right, fail=True)).count() == 0
    odd = right.withColumn("price", F.when(F.col("price") % 5 == 0, F.col("price") + 1).otherwise(F.col("price")))
    with pytest.raises(StreamingQueryException, match="the streams differ"):
        P.run_to_table(diff_stream(left, odd, fail=True))
    with pytest.raises(ValueError, match="column sets"):
        diff_stream(left, right.drop("price"))


def test_repeated_rows_are_counted(spark):
    folder = write_feed(spark, [[bid_event(1, 5, 10)] * 3 + [bid_event(2, 5, 11)], [bid_event(1, 5, 10)], [bid_event(9, 9, 1000)], [bid_event(9, 9, 1001)]])
    feed = P.timed(event_file_stream(spark, folder, 1).where("type = 'Bid'").select("bid.*"), "1 minute")
    got = P.run_to_table(diff_stream(feed.select("event_time", "auction"), feed.where("price < 9").select("event_time", "auction").union(
        feed.where("auction = 2").select("event_time", "auction"))))
    assert sorted((r.side, r.auction, r.n_more) for r in got.collect()) == [("right", 2, 1)]


def test_more_delay_drops_fewer_rows(spark):
    lost = {d: P.late_rows(spark, SF, d).where("what = 'dropped'").first().value for d in ("1 hour", "2 days", "20 days")}
    assert lost["1 hour"] > lost["2 days"] > lost["20 days"] == 0


# Latency reports


def test_live_latency_with_weights(spark):
    """Rows that stand for several samples, as micro-batches do."""
    samples = spark.range(600).select((F.lit(BASE) + F.col("id") * 7_000_000).alias("t_ns"), (F.col("id") * 7919 % 5003).alias("latency_ns"), (F.col("id") % 4).alias("rows"))
    feed = P.replayed(samples, "t_ns", batches=4).withColumn("event_time", F.timestamp_micros(F.call_function("div", F.col("t_ns"), F.lit(1000))))
    feed = feed.withWatermark("event_time", "0 seconds")
    got = P.run_to_table(P.latency_timeline_stream(feed, "500 milliseconds"))
    end = samples.agg(F.max("t_ns")).first()[0] // 10**6 * 10**6
    assert same(got, latency_timeline(samples, "500 milliseconds", sig_bits=4).where(F.col("slot_end_ns") <= end))
    folder = fresh("ccdf")
    writer, log = P.ccdf_writer(feed, folder + "/log")
    P.finished(writer, folder)
    assert same(P.ccdf_so_far(log), latency_ccdf(samples, sig_bits=4))


# Q5 by adding and retracting


@pytest.mark.parametrize("size, slide", [("60 seconds", "1 second"), ("6 seconds", "2 seconds"), ("1 second", "1 second")])
def test_deltas_equal_panes(spark, size, slide):
    """Bursts, quiet stretches over a window long, ties, and times before the epoch."""
    draw = random.Random(3)
    offers = [(draw.randrange(4), 1, 1, (draw.choice([-500, 0, 3, 40, 200, 5000]) + draw.randrange(90)) * 10**9 + draw.randrange(2) * 999_999_999) for _ in range(300)]
    b = bids(spark, offers)
    assert same(q5_hot_items_deltas(b, size, slide), q5_hot_items(b, size, slide))


def test_deltas_copy_no_panes(spark):
    """Three rows a pane; the only fan-out is on the best auctions of whole stretches."""
    plan = q5_hot_items_deltas(dense_bids(spark, SF), "1 hour", "1 minute")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and plan.index("Generate") < plan.index("Window") and plan.count("Union") == 1


# As-of join


def test_latest_before_against_brute_force(spark):
    draw = random.Random(11)
    left = [(i, draw.choice([None, 1, 1, 1, 2, 3]), draw.choice([None, *range(12)])) for i in range(400)]
    right = [(draw.choice([None, 1, 1, 2, 4]), draw.choice([None, *range(12)]), draw.choice([None, "a", "b", "c"])) for _ in range(80)]
    l, r = spark.createDataFrame(left, "id long, k long, t long"), spark.createDataFrame(right, "k long, t long, v string")
    want = []
    for i, k, t in left:
        seen = [x for x in right if None not in (k, t, *x[:2]) and x[0] == k and x[1] <= t]
        if seen:
            want.append((i, k, t, *max(seen, key=lambda x: (x[1], x[2] is not None, x[2] or ""))))
    got = latest_before(l, r, ("k", "k"), ("t", "t"), num_partitions=9)
    assert got.columns == ["id", "k", "t", "latest_k", "latest_t", "latest_v"]
    assert rows(got) == sorted(want, key=str) and len(want) > 100
    assert latest_before(l, r.where("false"), ("k", "k"), ("t", "t")).count() == 0


def test_latest_registration_of_a_hot_seller(spark):
    """One seller with most rows, and registrations all along."""
    people = persons(spark, [(1, "OR", 10 * i) if i % 3 else (1, "WA", 10 * i) for i in range(200)] + [(2, "ID", 5)])
    opened = auctions(spark, [dict(id=i, t=i, exp=10**6, seller=1 if i % 10 else 2) for i in range(2000)])
    got = q3_latest_registration(opened, people)
    p = people.select("id", "name", "city", "state", F.col("date_time_ns").alias("p_t"))
    met = opened.join(p, (opened["seller"] == p["id"]) & (p["p_t"] <= opened["date_time_ns"]))
    last = met.withColumn("at", F.row_number().over(Window.partitionBy(opened["id"]).orderBy(F.desc("p_t")))).where("at = 1")
    assert same(got, last.where("state IN ('OR', 'ID', 'CA')").select("name", "city", "state", opened["id"].alias("auction_id")))


def test_unique_people_give_plain_q3(spark):
    """With one registration each, before any auction, the as-of join is Q3."""
    people = persons(spark, [(i, s, 0) for i, s in enumerate(["OR", "WA", "ID", "CA", "AZ"])])
    opened = auctions(spark, [dict(id=i, t=5 + i, exp=10**6, seller=i % 6, category=10 + i % 2) for i in range(60)])
    assert same(q3_latest_registration(opened, people), q3_local_items(opened, people))


def test_state_stores_hold_for_the_query_only(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    with state_store(spark):
        assert "RocksDB" in spark.conf.get(key)
    assert spark.conf.get(key, None) == before
