"""Run original query names on the generated feed and report latency.

The original's main loop (pick queries, offer a rate for a duration, print a
latency CCDF and a timeline) as one function with arguments: the generated
`rate-micro-batch` feed carries `rate` events per second of event time, the
named query runs with a processing-time trigger for `duration`, and the
micro-batch progress becomes latency samples for the two reports, written as
tab-separated lines tagged `latency_ccdf` and `summary_timeline`.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from gavel.functions.time import NS_PER_SECOND, duration_ns
from gavel.operators.latency import latency_ccdf, latency_timeline, trim
from gavel.session import ensure_checkpoint_dir
from gavel.sources.generator import GeneratorConfig
from gavel.sources.sinks import write_report
from gavel.streaming.named import OF_EVENTS, parse, start_named
from gavel.streaming.progress import ProgressLog
from gavel.streaming.sources import generated_event_stream, generated_table_stream


def run_named(spark: SparkSession, name: str, rate: int, duration: str | int, out_dir: str,
              trigger: str = "1 second", sig_bits: int = 4, timeline_slot: str = "1 second",
              min_batches: int = 1, grace: str | int = "120 seconds", warmup: str | int = "2 seconds",
              cooldown: str | int = "2 seconds") -> tuple[DataFrame, DataFrame]:
    """Run `name` for `duration` at `rate` events/s; return (ccdf, timeline).

    The run lasts at least `duration` and until `min_batches` micro-batches
    have completed (start-up can outlast a short run), but at most
    `duration + grace`. The reports leave out `warmup` and `cooldown` at the
    ends of the run, as the original does, and count every micro-batch once for
    each of its input rows. Both reports are also written under `out_dir` (shared
    storage on a cluster); the query checkpoints under the session's
    checkpoint folder.
    """
    trigger_ns = duration_ns(trigger)
    per_batch = max(1, rate * trigger_ns // NS_PER_SECOND)
    start_ns = time.time_ns()
    cfg = GeneratorConfig(base_time_ns=start_ns, events_per_second=rate,
                          in_flight_auctions=max(100, rate * 2592 // 1000))
    ckpt = f"{ensure_checkpoint_dir(spark).rstrip('/')}/run-{name}-{uuid.uuid4().hex}"
    feed = generated_event_stream if parse(name)[0] in OF_EVENTS else generated_table_stream
    q = start_named(spark, name, feed(spark, per_batch, cfg), f"{ckpt}-table", ckpt,
                    trigger=f"{trigger_ns // 1_000_000} milliseconds")
    log = ProgressLog(q)
    started = time.monotonic()
    run_s = duration_ns(duration) / NS_PER_SECOND
    limit_s = run_s + duration_ns(grace) / NS_PER_SECOND
    while q.isActive:
        elapsed = time.monotonic() - started
        done = log.poll()
        if elapsed >= limit_s or (elapsed >= run_s and done >= min_batches):
            break
        time.sleep(0.2)
    samples = log.samples(spark)
    q.stop()
    samples = trim(samples, start_ns, time.time_ns(), warmup, cooldown)
    ccdf = latency_ccdf(samples, sig_bits=sig_bits)
    timeline = latency_timeline(samples, timeline_slot, sig_bits=sig_bits)
    base = out_dir.rstrip("/")
    write_report(ccdf, f"{base}/{name}/latency_ccdf", "latency_ccdf", ["latency"])
    write_report(timeline, f"{base}/{name}/summary_timeline", "summary_timeline", ["slot_end_ns"])
    return ccdf, timeline
