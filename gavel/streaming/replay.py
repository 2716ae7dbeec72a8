"""Ordered replay: a table as a stream that arrives in time order, in as many micro-batches as asked for.

Rows are cut in time order into files of equal length, each written by one task; a file stream then takes so many files
a micro-batch, in that order. So the watermark moves on from batch to batch, windows close and state is evicted, as
with a live feed. The keys of the cuts are found by passes over (time, hash) that only summaries of leave the tasks
(`places`); then each row goes to its file in one shuffle of compressed blobs (`blobs`).

Bounded disorder: within groups of `disorder` rows, row number k of the arrival order is row
`(k * 953) mod disorder` of its group in time order, so no row comes more than a group late. What is left over after
the last whole group comes in order. Here each row needs its number (a running count over ranges, no single task).
"""

from __future__ import annotations

import sys
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from math import gcd

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gavel.functions.time import idiv
from gavel.operators.running import running_frame
from gavel.sources.files import order_by_time, part_files
from gavel.streaming.blobs import chunks, cut, decoded, numbers, pieces

# Workers get this module's code with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed value: the multiplier of the bounded disorder.
STRIDE = 953

# Keys that a task's summary of half a million rows holds, over all cuts.
SUMMARY = 4096

# Time of rows without one, which come first.
FIRST = -(1 << 63)

Key = tuple[int, int]
Span = tuple[Key | None, Key | None]

SUMMARIES = "j long, below long, t array<long>, tie array<long>, n array<long>"


@dataclass
class Replay:
    folder: str
    schema: T.StructType
    rows: int
    rows_per_file: int
    files_per_batch: int

    def stream(self, spark: SparkSession) -> DataFrame:
        """The table as a stream, a micro-batch of `files_per_batch` files at a time."""
        return (spark.readStream.schema(self.schema).option("maxFilesPerTrigger", self.files_per_batch)
                .parquet(self.folder))


def arrival(number: Column, disorder: int, rows: int) -> Column:
    """The place in arrival order of a row, by its number (from 0) in time order."""
    if disorder == 1:
        return number
    if disorder < 1 or gcd(STRIDE, disorder) != 1:
        raise ValueError(f"disorder must be at least 1 and share no factor with {STRIDE}")
    back = pow(STRIDE, -1, disorder)
    within = F.pmod(number, F.lit(disorder))
    moved = number - within + F.pmod(within * F.lit(back), F.lit(disorder))
    return F.when(number < rows // disorder * disorder, moved).otherwise(number)


def _summarizer(spans: list[Span], most: int):
    """Of the keys strictly between the ends of each span: every so many a sample (`n`: the keys since the sample before);
    and how many are at or below its lower end."""
    def run(batches):
        for rows in chunks(batches):
            t, tie = numbers(rows["t"])[0], numbers(rows["tie"])[0]
            order = np.lexsort((tie, t))
            t, tie = t[order], tie[order]

            def key(i: int) -> Key:
                return int(t[i]), int(tie[i])
            out = []
            for j, (low, high) in enumerate(spans):
                a = 0 if low is None else bisect_right(range(len(t)), low, key=key)
                b = len(t) if high is None else bisect_left(range(len(t)), high, key=key)
                apart = max(1, -(-(b - a) // most))
                at = np.append(np.arange(a + apart - 1, b - 1, apart), b - 1) if b > a else np.zeros(0, np.int64)
                out.append({"j": j, "below": a, "t": t[at], "tie": tie[at], "n": np.diff(at, prepend=a - 1)})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("j", pa.int64()), ("below", pa.int64()), *((c, pa.list_(pa.int64())) for c in ("t", "tie", "n"))]))
    return run


def _narrowed(summaries: pa.Table, ranks: list[int], span: Span) -> Iterator[tuple[Key | None, Span]]:
    """For each number (from 1) of a key in a span: the key, if the span's summaries settle it, and else a narrower span."""
    inside = {c: pc.list_flatten(summaries[c]).to_numpy() for c in ("t", "tie", "n")}
    task = pc.list_parent_indices(summaries["n"].combine_chunks()).to_numpy()
    t, tie, n = inside["t"], inside["tie"], inside["n"]
    # A key between two samples of a task: up to the earlier one there may be all but one of the step between them.
    same = np.append(task[1:] == task[:-1], False)[:len(n)]
    after = np.where(same, np.append(n[1:], 1)[:len(n)], 1)
    first = np.insert(~same[:-1], 0, True)[:len(n)]
    order = np.lexsort((tie, t))
    t, tie, n, after = t[order], tie[order], n[order], after[order]
    least = np.cumsum(n)
    most = least + int((inside["n"][first] - 1).sum()) + np.cumsum(after - n)
    whole = np.append((t[1:] != t[:-1]) | (tie[1:] != tie[:-1]), True)[:len(n)]
    below = sum(summaries["below"].to_pylist())
    for rank in ranks:
        rank -= below
        if not len(n) or rank > least[-1]:
            yield span[1], span
            continue
        high = int(np.searchsorted(least, rank))
        lower = np.flatnonzero(whole[:high] & (most[:high] < rank))
        key = int(t[high]), int(tie[high])
        low = (int(t[lower[-1]]), int(tie[lower[-1]])) if len(lower) else span[0]
        yield (key if (n == 1).all() else None), (low, key)


def keys_at(keys: DataFrame, ranks: list[int]) -> list[Key]:
    """The keys (t, tie) of the rows with these numbers (from 1) in the order of (t, tie). Exact; what reaches the driver
    is bounded by the tasks' summaries."""
    got: dict[int, Key] = {}
    spans: dict[Span, list[int]] = {(None, None): list(ranks)} if ranks else {}
    while spans:
        asked, made = spans, keys.mapInArrow(_summarizer(list(spans), max(64, SUMMARY // len(spans))), SUMMARIES).toArrow()
        spans = {}
        for j, (span, wanted) in enumerate(asked.items()):
            for rank, (key, narrower) in zip(wanted, _narrowed(made.filter(pc.equal(made["j"], j)), wanted, span)):
                if key is None:
                    spans.setdefault(narrower, []).append(rank)
                else:
                    got[rank] = key
    return [got[r] for r in ranks]


def _file_of(t: np.ndarray, tie: np.ndarray, cuts: list[Key]) -> np.ndarray:
    """How many cuts come before each key; a cut is the last key of its file."""
    if not cuts:
        return np.zeros(len(t), np.int64)
    ct, ctie = (np.array(x, np.int64) for x in zip(*cuts))
    file, most = np.searchsorted(ct, t, "left"), np.searchsorted(ct, t, "right")
    at = np.flatnonzero(file < most)
    while len(at):
        at = at[tie[at] > ctie[file[at]]]
        file[at] += 1
        at = at[file[at] < most[at]]
    return file


def _dealer(cuts: list[Key]):
    def run(batches):
        for rows in chunks(batches):
            made = list(cut(rows, _file_of(numbers(rows["__t"])[0], numbers(rows["__tie"])[0], cuts)))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in made], pa.int32()), pa.array([x for _, x in made], pa.binary())], names=["file", "rows"])
    return run


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a file in their order."""
    held = [decoded(blob) for batch in batches for blob in batch.column(1).to_pylist()]
    if held:
        rows = pa.concat_tables(held)
        order = np.lexsort((numbers(rows["__tie"])[0], numbers(rows["__t"])[0]))
        rows = rows.drop_columns(["__t", "__tie"])
        del held
        for a in range(0, len(order), 1 << 16):
            yield from pieces(rows.take(pa.array(order[a:a + (1 << 16)])))


def _dealt(df: DataFrame, time_col: str, files: int) -> tuple[DataFrame, int, int]:
    """(the rows of each file in a partition of its own, number of rows, rows of a file)."""
    columns = df.columns
    keyed = df.select(*columns, F.coalesce(time_col, F.lit(FIRST)).alias("__t"), F.xxhash64(*columns).alias("__tie"))
    rows = df.select(time_col).count()
    size = max(1, -(-rows // files))
    cuts = keys_at(keyed.select(F.col("__t").alias("t"), F.col("__tie").alias("tie")), list(range(size, rows, size)))
    blobs = keyed.mapInArrow(_dealer(cuts), "file int, rows binary").repartitionById(files, "file")
    return blobs.mapInArrow(_ordered, df.schema), rows, size


def _numbered(df: DataFrame, time_col: str, files: int, disorder: int) -> tuple[DataFrame, int, int]:
    """As `_dealt`, of rows in bounded disorder."""
    columns = df.columns
    numbered = running_frame(df.select(*columns, F.xxhash64(*columns).alias("__tie"), F.lit(0).alias("__all"), F.lit(1).alias("__one")),
                             ["__all"], [time_col, "__tie"], "__one")
    rows = numbered.count()
    size = max(1, -(-rows // files))
    at = arrival(F.col("frame_count") - 1, disorder, rows)
    dealt = numbered.select(*columns, at.alias("__at")).repartitionById(files, idiv("__at", F.lit(size)).cast("int"))
    return dealt.sortWithinPartitions("__at").drop("__at"), rows, size


def write_replay(df: DataFrame, folder: str, time_col: str, batches: int, files_per_batch: int = 1, disorder: int = 1) -> Replay:
    """Write `df` into a fresh folder as a feed of at most `batches` micro-batches. Rows of equal time come in the
    order of a hash of the row; rows without a time come first; equal rows of equal time are in one file."""
    files = batches * files_per_batch
    dealt, rows, size = _dealt(df, time_col, files) if disorder == 1 else _numbered(df, time_col, files, disorder)
    dealt.write.parquet(folder)
    order_by_time(df.sparkSession, part_files(df.sparkSession, folder))
    return Replay(folder, df.schema, rows, size, files_per_batch)
