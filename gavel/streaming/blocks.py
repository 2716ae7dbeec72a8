"""Closed auctions by blocks of auctions: the sessions of `closing`, found for a block of ids at once.

One state row per auction and per bid outside every session costs several look-ups and writes of the state store
each. Where micro-batches are large, ids are hashed to blocks instead, a micro-batch's rows of a block come as a few blobs
(`blobs`), and the state of a block is one blob: its open sessions, the best bid of each, and the bids that no session
holds yet. A block's step merges what it has with what has come, in arrays:

* auctions of one id that overlap are one session, which keeps the greatest (category, seller, expires, reserve);
* a bid belongs to the session of its id that holds its time; only a session's best bid is kept;
* sessions whose end the watermark has passed leave, with their best bid if it reaches the reserve; bids that
  no session holds leave with the watermark too;
* rows behind the watermark of the micro-batch before are late and dropped, as Spark drops them.

A salted id has each salt in another block; what its salts give in one micro-batch is merged after it, as all salts
of a session close in the same micro-batch.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import (
    ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues,
)

from gavel.streaming.blobs import chunks, cut, decoded, encoded, longs, numbers, pieces

# Workers get this module's code with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Rows of a micro-batch in one block, at most on average.
BLOCK_ROWS = 1 << 18

# A row in a block costs about this part of a row of its own.
SHARE = 8

# An auction has begin, end, expires_ns, category, seller and reserve here, a bid begin, bidder and price (no end).
COLUMNS = ["id", "begin", "end", "expires_ns", "x", "y", "z"]
FOUND = ["auction", "category", "seller", "expires_ns", "bidder", "price", "bid_time_ns", "begin"]


def rows_by_blocks(rows: int) -> int:
    """Rows that cost a state store by rows about what `rows` cost by blocks: for the number of shards."""
    return -(-rows // SHARE)


def block_labels(spark: SparkSession, rows: int, shards: int, least: int) -> list[int]:
    """The keys of the blocks for micro-batches of `rows` rows: equally many in each of the `shards` of a state store."""
    each = max(1, -(-rows // (BLOCK_ROWS * shards)), -(-least // shards))
    places: dict[int, list[int]] = {s: [] for s in range(shards)}
    tried = 0
    while min(map(len, places.values())) < each:
        more = spark.range(tried, tried + 16 * each * shards).select("id", F.pmod(F.hash("id"), F.lit(shards)).alias("s"))
        for r in more.collect():
            places[r.s].append(r.id)
        tried += 16 * each * shards
    return [label for found in places.values() for label in found[:each]]


def _ranked(values: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Sort keys for lexsort, the first value the most significant, nulls smallest."""
    return [k for v, null in reversed(values) for k in (v, ~null)]


def _sessions(c: dict[str, tuple[np.ndarray, np.ndarray]]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Auctions in the order of (id, begin), those of one id that overlap merged."""
    order = np.lexsort((c["begin"][0], c["id"][0]))
    c = {k: (v[order], null[order]) for k, (v, null) in c.items()}
    ids, begin, end = c["id"][0], c["begin"][0], c["end"][0]
    first = np.ones(len(ids), bool)
    first[1:] = ids[1:] != ids[:-1]
    if first.all():
        return c
    start = np.maximum.accumulate(np.where(first, np.arange(len(ids)), 0))
    rank, reach = np.arange(len(ids)) - start, end.copy()
    by_rank = np.argsort(rank, kind="stable")
    bounds = np.searchsorted(rank[by_rank], np.arange(1, rank.max() + 2))
    for a, b in zip(bounds, bounds[1:]):
        i = by_rank[a:b]
        within = begin[i] <= reach[i - 1]
        reach[i] = np.where(within, np.maximum(end[i], reach[i - 1]), end[i])
        first[i] = ~within
    starts, session = np.flatnonzero(first), np.cumsum(first) - 1
    last = np.append(starts[1:], len(ids)) - 1
    # The greatest (category, seller, expires, reserve) of a session is its auction.
    greatest = np.lexsort((*_ranked([c["x"], c["y"], c["expires_ns"], c["z"]]), session))[last]
    out = {k: (v[greatest], null[greatest]) for k, (v, null) in c.items()}
    none = np.zeros(len(starts), bool)
    return out | {"begin": (begin[starts], none), "end": (reach[last], none)}


def _best(session: np.ndarray, c: dict[str, tuple[np.ndarray, np.ndarray]], at: np.ndarray) -> np.ndarray:
    """Of the bids at places `at`, in the order of their sessions: the best of each session (price up, time down, bidder
    down, nulls last)."""
    (bidder, no_bidder), (price, no_price), (begin, _) = c["x"], c["y"], c["begin"]
    for key in (~no_price, price, -begin, ~no_bidder, -bidder):
        if not len(at):
            break
        starts = np.flatnonzero(np.concatenate(([True], session[1:] != session[:-1])))
        if len(starts) == len(at):
            break
        value = key[at].astype(np.int64)
        top = np.repeat(np.maximum.reduceat(value, starts), np.diff(np.append(starts, len(at))))
        keep = value == top
        session, at = session[keep], at[keep]
    first = np.concatenate(([True], session[1:] != session[:-1])) if len(at) else np.zeros(0, bool)
    return at[first]


def _table(c: dict[str, tuple[np.ndarray, np.ndarray]], at: np.ndarray) -> pa.Table:
    return pa.table([longs(c[k][0][at], c[k][1][at]) for k in COLUMNS], names=COLUMNS)


def step(held: pa.Table | None, new: list[pa.Table], late: int, now: int) -> tuple[pa.Table, pa.Table]:
    """What a block closes and what it keeps, of what it held and what has come. `late` and `now`: the watermark of the
    micro-batch before and of this one, on the clock of the sessions."""
    come = pa.concat_tables(new) if new else pa.table([longs(np.zeros(0, np.int64))] * len(COLUMNS), names=COLUMNS)
    begin, (end, is_bid) = numbers(come["begin"])[0], numbers(come["end"])
    come = come.filter(pa.array(np.where(is_bid, begin + 1, end) > late))
    rows = come if held is None else pa.concat_tables([held, come])
    c = {k: numbers(rows[k]) for k in COLUMNS}
    is_bid = c["end"][1]
    s = _sessions({k: (v[~is_bid], null[~is_bid]) for k, (v, null) in c.items()})
    b = {k: (v[is_bid], null[is_bid]) for k, (v, null) in c.items()}
    n, ids = len(s["id"][0]), np.concatenate((s["id"][0], b["id"][0]))
    order = np.lexsort((np.arange(len(ids)) >= n, np.concatenate((s["begin"][0], b["begin"][0])), ids))
    # In the order of (id, begin), the session that began last before each row.
    before = np.cumsum(order < n) - 1
    bid = order >= n
    at, before = order[bid] - n, before[bid]
    if n:
        of = np.maximum(before, 0)
        inside = (before >= 0) & (s["id"][0][of] == b["id"][0][at]) & (b["begin"][0][at] < s["end"][0][of])
    else:
        inside = np.zeros(len(at), bool)
    best = _best(before[inside], b, at[inside])
    session = np.full(len(b["id"][0]), -1)
    session[at[inside]] = before[inside]
    has = session[best]  # the sessions that have a bid
    over = s["end"][0] <= now
    (price, no_price), (reserve, no_reserve) = b["y"], s["z"]
    won = over[has] & ~no_price[best] & ~no_reserve[has] & (price[best] >= reserve[has])
    w, v = has[won], best[won]
    made = [s["id"], s["x"], s["y"], s["expires_ns"]]
    closed = pa.table([longs(x[w], null[w]) for x, null in made]
                      + [longs(b["x"][0][v], b["x"][1][v]), longs(price[v]), longs((b["begin"][0][v] - 1) // 3), longs(s["begin"][0][w])], names=FOUND)
    alone = at[~inside]
    alone = alone[b["begin"][0][alone] + 1 > now]
    kept = pa.concat_tables([_table(s, np.flatnonzero(~over)), _table(b, best[~over[has]]), _table(b, alone)])
    return closed, kept


class BlockProcessor(StatefulProcessor):
    """State of a block: the watermark of its last step, and its rows. A timer behind the watermark calls every block in
    the next micro-batch that has a later one. `step` gets times in us."""

    def __init__(self, step):
        self.step = step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("block", "wm_ms long, rows binary")

    def _run(self, new: list[pa.Table], now_ms: int) -> Iterator[pd.DataFrame]:
        before = self.state.get()
        late_ms, rows = (0, None) if before is None else before
        closed, kept = self.step(None if rows is None else decoded(bytes(rows)), new, late_ms * 1000, now_ms * 1000)
        self.state.update((now_ms, encoded(kept) if kept.num_rows else None))
        if before is None or now_ms > late_ms:
            if before is not None:
                self.handle.deleteTimer(late_ms + 1)
            self.handle.registerTimer(now_ms + 1)
        if closed.num_rows:
            yield pd.DataFrame({"found": [encoded(closed)]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = [decoded(blob) for some in rows for blob in some["rows"] if blob is not None]
        return self._run(new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        return self._run([], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def _of_length(rows: pa.Table) -> pa.Table:
    """Without auctions of no length, which hold no bid."""
    end, no_end = numbers(rows["end"])
    return rows.filter(pa.array(~rows["opens"].to_numpy() | (~no_end & (end > numbers(rows["begin"])[0]))))


def _packer(labels: list[int], columns: list[str], some):
    """`some` of the rows as blobs of `columns` by block (`spread`); the first task calls every block."""
    def run(batches):
        from pyspark import TaskContext
        names = np.array(labels, np.int64)
        if TaskContext.get().partitionId() == 0:
            yield pa.RecordBatch.from_arrays([longs(names), pa.nulls(len(names), pa.binary())], names=["block", "rows"])
        for rows in map(some, chunks(batches)):
            made = list(cut(pa.table(rows.select(columns).columns, names=columns), numbers(rows["spread"])[0] % len(labels)))
            if made:
                yield pa.RecordBatch.from_arrays([longs(names[[k for k, _ in made]]), pa.array([x for _, x in made], pa.binary())], names=["block", "rows"])
    return run


def _unpack(batches):
    for batch in batches:
        for blob in batch.column(0).to_pylist():
            yield from pieces(decoded(blob))


def _merger(hot: list[int]):
    """Of the rows that the salts of a hot auction's session gave, the winner; all others as they are."""
    def run(batches):
        held, ids = [], pa.array(hot, pa.int64())
        for batch in batches:
            salted = pc.is_in(batch.column("auction"), ids)
            held.append(batch.filter(salted))
            yield batch.filter(pc.invert(salted))
        best = {}
        for r in (r for batch in held for r in batch.to_pylist()):
            key = r["auction"], r["begin"]
            rank = r["price"], -r["bid_time_ns"], r["bidder"] is not None, -(r["bidder"] or 0)
            if key not in best or rank > best[key][0]:
                best[key] = rank, r
        if best:
            yield pa.RecordBatch.from_pylist([r for _, r in best.values()], schema=held[0].schema)
    return run


def _spread(id_: str, labels: list[int]) -> Column:
    """The number of a row's block; each salt of an id has another one."""
    return (F.pmod(F.xxhash64(id_), F.lit(len(labels))) + F.col("salt")).alias("spread")


def _found(flat: DataFrame, labels: list[int], columns: list[str], some, step, hot: list[int]) -> DataFrame:
    found = (flat.mapInArrow(_packer(labels, columns, some), "block long, rows binary").groupBy("block")
             .transformWithStateInPandas(BlockProcessor(step), "found binary", "Append", "EventTime")
             .mapInArrow(_unpack, ", ".join(f"{c} long" for c in FOUND)))
    return found.repartition("auction").mapInArrow(_merger(hot), found.schema) if hot else found


def closed_by_blocks(rows: DataFrame, labels: list[int], hot: list[int]) -> DataFrame:
    """FOUND of watermarked session rows (id, salt, begin, ticks, a, b): `closing.session_rows`."""
    opens = F.col("a").isNotNull()
    begin = F.unix_micros("begin")
    flat = rows.select(_spread("id", labels), opens.alias("opens"), "id", begin.alias("begin"),
                       F.when(opens, begin + F.col("ticks")).alias("end"), F.col("a.expires_ns").alias("expires_ns"),
                       F.coalesce("a.category", "b.bidder").alias("x"), F.coalesce("a.seller", "b.price").alias("y"), F.col("a.reserve").alias("z"))
    return _found(flat, labels, COLUMNS, _of_length, step, hot)


# Bounded closing: a row is an auction, a bid, or the best bid so far of an auction (`at`: its start, or the bid's time).
AUCTION, BID, WINNER = range(3)
BOUNDED = ["kind", "id", "at", "expires_ns", "category", "seller", "reserve", "bidder", "price"]


def _close_us(expires_ns: np.ndarray) -> np.ndarray:
    return (expires_ns + 1_000_000) // 1000


def bounded_step(bound_us: int):
    """As `step`, for auctions of bounded length, as a join of bids and auctions with an arg-max per 1 ms of close time
    does it: an auction waits for bids until the watermark passes its close, a bid for auctions as long as the bound; a
    winner leaves once the watermark less the bound has passed its close."""
    def run(held: pa.Table | None, new: list[pa.Table], late: int, now: int) -> tuple[pa.Table, pa.Table]:
        come = pa.concat_tables(new) if new else pa.table([longs(np.zeros(0, np.int64))] * len(BOUNDED), names=BOUNDED)
        expires, at, kind = (numbers(come[k])[0] for k in ("expires_ns", "at", "kind"))
        come = come.filter(pa.array(np.where(kind == BID, at // 1000, _close_us(expires)) > late))
        rows = come if held is None else pa.concat_tables([held, come])
        c = {k: numbers(rows[k]) for k in BOUNDED}
        kind = c["kind"][0]
        a, b, g = ({k: (v[kind == x], null[kind == x]) for k, (v, null) in c.items()} for x in (AUCTION, BID, WINNER))
        order = np.lexsort((b["at"][0], b["id"][0]))
        b = {k: (v[order], null[order]) for k, (v, null) in b.items()}
        # The bids of an auction's id from its start to its expiry are a range in the order of (id, time).
        n, m = len(a["id"][0]), len(order)
        marks = np.lexsort((np.repeat([0, 1], [2 * n, m]), np.concatenate((a["at"][0], a["expires_ns"][0], b["at"][0])),
                            np.concatenate((a["id"][0], a["id"][0], b["id"][0]))))
        place = np.empty(2 * n + m, np.int64)
        place[marks] = np.cumsum(marks >= 2 * n)
        first, many = place[:n], np.maximum(place[n:2 * n] - place[:n], 0)
        of = np.repeat(np.arange(n), many)
        bid = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + first[of]
        valid = b["price"][0][bid] >= a["reserve"][0][of]
        of, bid = of[valid], bid[valid]
        best = _best(of, {k: (v[0][bid], v[1][bid]) for k, v in (("x", b["bidder"]), ("y", b["price"]), ("begin", b["at"]))}, np.arange(len(of)))
        of, bid = of[best], bid[best]
        w = {k: tuple(np.concatenate((g[k][i], src[k][i][pick])) for i in (0, 1))
             for k, src, pick in [(k, a, of) for k in ("id", "expires_ns", "category", "seller")] + [(k, b, bid) for k in ("at", "bidder", "price")]}
        window = _close_us(w["expires_ns"][0]) // 1000 * 1000 + 1000  # the end of the 1 ms of the close
        order = np.lexsort((-w["bidder"][0], ~w["bidder"][1], -w["at"][0], w["price"][0], window, w["id"][0]))
        ids, ends = w["id"][0][order], window[order]
        top = order[np.append((ids[1:] != ids[:-1]) | (ends[1:] != ends[:-1]), True)[:len(order)]]
        over = window[top] <= (now - bound_us) // 1000 * 1000 - 1000
        out, stay = top[over], top[~over]
        closed = pa.table([longs(w[k][0][out], w[k][1][out]) for k in ("id", "category", "seller", "expires_ns", "bidder", "price", "at")]
                          + [longs(window[out] - 1)], names=FOUND)
        w |= {"kind": (np.full(len(window), WINNER), np.zeros(len(window), bool)), "reserve": (np.zeros(len(window), np.int64), np.ones(len(window), bool))}
        kept = [(a, np.flatnonzero(_close_us(a["expires_ns"][0]) > now)), (b, np.flatnonzero(b["at"][0] // 1000 > now - bound_us - 1000)), (w, stay)]
        return closed, pa.concat_tables([pa.table([longs(x[k][0][at], x[k][1][at]) for k in BOUNDED], names=BOUNDED) for x, at in kept])
    return run


def bounded_by_blocks(auction: DataFrame, bid: DataFrame, bound_us: int, labels: list[int], salts: int, hot: list[int]) -> DataFrame:
    """FOUND, `begin` being the time of a row, of auctions (id, at, expires_ns, category, seller, reserve) and bids (id, at,
    bidder, price), each with its watermark. An id in `hot` has its bids dealt to `salts` blocks, its auction to all of them."""
    def salted(rows: DataFrame, kind: int, many: Column) -> DataFrame:
        dealt = F.when(F.col("id").isin(hot), many).otherwise(F.array(F.lit(0))) if hot else F.array(F.lit(0))
        none = [F.lit(None).cast("long").alias(k) for k in BOUNDED[1:] if k not in rows.columns]
        return rows.select(F.lit(kind).cast("long").alias("kind"), *[k for k in rows.columns if k in BOUNDED], *none, F.explode(dealt).alias("salt"))
    rows = salted(auction, AUCTION, F.sequence(F.lit(0), F.lit(salts - 1))).unionByName(
        salted(bid, BID, F.array(F.pmod(F.xxhash64("at", "bidder", "price"), F.lit(salts)).cast("int"))))
    return _found(rows.select(_spread("id", labels), *BOUNDED), labels, BOUNDED, lambda rows: rows, bounded_step(bound_us), hot)
