"""The original query names (q0 ... q8 with state back-end suffixes).

A name picks one query and, through its suffix, a state store: the
in-memory back ends map to Spark's HDFS-backed store (in-memory maps with
checkpointed deltas), the on-disk ones and the plain names to RocksDB with
changelog checkpointing (the fastest here). Keyed processors (q4 and q6 with a
state bound) always use RocksDB, which transformWithState requires.
Window sizes default to the original workload: Q5 60 s sliding by 1 s, Q7
10 s, Q8 12 h.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from gavel.operators.averages import Q6_LAST
from gavel.sources.events import demux
from gavel.sources.tables import AuctionTables
from gavel.streaming import queries as S
from gavel.streaming.closing import closed_auctions_sessions
from gavel.streaming.fanout import Sink, fan_out, table_sink
from gavel.streaming.frames import means_sink
from gavel.streaming.sources import ROCKSDB, state_store, timed_events, timed_tables

HDFS = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"

PROVIDERS = {
    "": ROCKSDB, "mem": HDFS, "mem_native": HDFS, "faster_in_mem": HDFS,
    "faster": ROCKSDB, "faster_node": ROCKSDB, "rocksdb": ROCKSDB,
}

# What the queries without state make of a micro-batch of tagged events.
STATELESS = {"q0": lambda events: events,
             "q1": lambda events: S.q1_currency(demux(events).bid),
             "q2": lambda events: S.q2_selection(demux(events).bid)}

# Names that read the union itself; the others read relations.
OF_EVENTS = ("q0", "q4", "q6")

BASES = ("q0", "q1", "q2", "q3", "q4", "q5", "q6", "q7", "q8")
NAMES = (["q0", "q1", "q2"] + ["q3", "q3_faster", "q3_rocksdb", "q3_faster_node", "q3_faster_in_mem", "q3_mem",
                               "q3_mem_native"]
         + [f"{b}{s}" for b in ("q4", "q5", "q6", "q7", "q8")
            for s in ("", "_mem", "_faster", "_rocksdb", "_faster_in_mem")])


def parse(name: str) -> tuple[str, str]:
    base, _, suffix = name.partition("_")
    if name not in NAMES or base not in BASES:
        raise ValueError(f"unknown query {name!r}; known: {', '.join(NAMES)}")
    return base, suffix


def closing_stream(events: DataFrame, delay: str | int = "0 seconds",
                   max_auction_length: str | int | None = None) -> DataFrame:
    """Closed auctions of a tagged event stream: by session windows, or by a join that fails on an auction longer
    than a given length."""
    if max_auction_length is not None:
        return S.closed_auctions_stream_bounded(events, max_auction_length, delay)
    return closed_auctions_sessions(events, delay)


def named_stream(name: str, events: DataFrame | AuctionTables, delay: str = "0 seconds",
                 state_bound: str | int | None = None) -> tuple[DataFrame, str | None]:
    """(streaming DataFrame, state provider) for an original query name but q4 and q6, which are sinks of
    a closing stream (`means_of`) unless a state bound asks for keyed processors.

    `events` is a stream of tagged events (e.g. `generated_event_stream`) or, for a query that reads relations,
    their watermarked streams (e.g. `generated_table_stream`). `state_bound` bounds the state of q3 (event
    time), q4 and q6 (processing time), which otherwise grows with the keys, as in the original.
    """
    base, suffix = parse(name)
    provider = PROVIDERS[suffix]
    if base == "q0":
        return timed_events(events, delay), provider
    t = events if isinstance(events, AuctionTables) else timed_tables(timed_events(events, delay))
    if base == "q1":
        return S.q1_currency(t.bid), provider
    if base == "q2":
        return S.q2_selection(t.bid), provider
    if base == "q3":
        return S.q3_stream(t.auction, t.person, state_bound), provider
    if base == "q5":
        return S.q5_stream_panes(t.bid), provider  # 3x faster than window(60 s, 1 s) on raw bids
    if base == "q7":
        return S.q7_stream(t.bid), provider
    if base == "q8":
        return S.q8_stream(t.person, t.auction), provider
    if state_bound is None:
        raise ValueError(f"{name} is a sink of the closing stream; start it with start_named")
    closed = S.closed_auctions_stream(t.auction, t.bid)
    if base == "q4":
        return S.q4_running_stream(closed, state_bound), ROCKSDB
    return S.q6_stream(closed, "bidder", ttl=state_bound), ROCKSDB


def means_of(spark: SparkSession, base: str, sink_path: str, state_path: str) -> Sink:
    """The sink of closed auctions that q4 and q6 are."""
    key, last = ("category", None) if base == "q4" else ("bidder", Q6_LAST)
    return means_sink(spark, sink_path, state_path, key, last)


def sink_checkpoint(spark: SparkSession, name: str, sink_path: str) -> str:
    """The checkpoint folder of one query into one sink, under the session's
    shared folder: a second sink has offsets of its own, and a restart of the
    same name into the same sink resumes."""
    from gavel.session import ensure_checkpoint_dir
    sink = hashlib.sha256(sink_path.rstrip("/").encode()).hexdigest()[:16]
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/streams/{name}-{sink}"


def _started(writer: DataStreamWriter, label: str, checkpoint: str, available_now: bool, trigger: str | None,
             provider: str | None, spark: SparkSession) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint).queryName(label)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif trigger:
        writer = writer.trigger(processingTime=trigger)
    with state_store(spark, provider):
        return writer.start()


def start_named(spark: SparkSession, name: str, events: DataFrame | AuctionTables, sink_path: str,
                checkpoint: str | None = None, delay: str = "0 seconds", available_now: bool = False,
                fmt: str = "parquet", max_auction_length: str | int | None = None,
                state_bound: str | int | None = None, trigger: str | None = None) -> StreamingQuery:
    """Start a named query into a table folder; its checkpoint defaults to a
    folder for this name and sink (`sink_checkpoint`). q4 and q6 compute their
    means per micro-batch of closed auctions on built-in operators, into parquet,
    unless a state bound asks for the keyed form."""
    base, suffix = parse(name)
    ckpt = checkpoint or sink_checkpoint(spark, name, sink_path)
    label = f"{name}-{ckpt.rsplit('-', 1)[-1]}"
    if base in ("q4", "q6") and state_bound is None:
        if fmt != "parquet":
            raise ValueError(f"{name} writes parquet")
        closed = closing_stream(events, delay, max_auction_length)
        writer = fan_out(closed, {name: means_of(spark, base, sink_path, f"{ckpt}-means")})
        return _started(writer, label, ckpt, available_now, trigger, PROVIDERS[suffix], spark)
    df, provider = named_stream(name, events, delay, state_bound)
    writer = df.writeStream.format(fmt).option("path", sink_path).outputMode("append")
    return _started(writer, label, ckpt, available_now, trigger, provider, spark)


def start_together(spark: SparkSession, names: list[str], events: DataFrame, folder: str, delay: str = "0 seconds",
                   available_now: bool = False, trigger: str | None = None) -> dict[str, StreamingQuery]:
    """Start several named queries, each into `folder`/name. Those that need no state share one query and its read of
    the source; q4 and q6 of one state store share another, which closes the auctions once for all of them. The other
    names run as queries of their own."""
    folder = folder.rstrip("/")
    shared: dict[tuple[str, str | None], dict[str, Sink]] = {}
    out: dict[str, StreamingQuery] = {}
    for name in dict.fromkeys(names):
        base, suffix = parse(name)
        path = f"{folder}/{name}"
        if base in STATELESS:
            shared.setdefault(("stateless", None), {})[name] = table_sink(path, STATELESS[base])
        elif base in ("q4", "q6"):
            sink = means_of(spark, base, path, f"{sink_checkpoint(spark, name, path)}-means")
            shared.setdefault(("closing", PROVIDERS[suffix]), {})[name] = sink
        else:
            out[name] = start_named(spark, name, events, path, None, delay, available_now, trigger=trigger)
    for (kind, provider), sinks in shared.items():
        source = events if kind == "stateless" else closing_stream(events, delay)
        label = f"{kind}-{'-'.join(sinks)}"
        query = _started(fan_out(source, sinks), label, sink_checkpoint(spark, label, folder), available_now, trigger, provider, spark)
        out.update(dict.fromkeys(sinks, query))
    return out
