"""Keyed processors for what built-in streaming operators cannot express.

* `ClosingProcessor`: closed auctions. The emit time is a data value (the
  auction's `expires`), so it is an event-time timer per auction, not a
  window. State per auction: the auction, its best valid bid so far, and bids
  that came before the auction (kept until the watermark passes their time,
  after which their auction can no longer arrive with an earlier start).
* `RunningMeanProcessor`: Q4 running mean per category, one row per closed auction.
* `LastKMeanProcessor`: Q6 mean of a key's last k closing prices.

The last two expect their input in closing order across micro-batches, which
the closing operator guarantees (an auction is emitted only once the
watermark passes its expiry); inside a micro-batch they sort by (expires,
auction). They can follow the closing operator in the same query (its output
declares `event_time`) or read its output table in a second query.
All three keep per-key state in the RocksDB state store, sharded by key over
the shuffle partitions, and checkpointed with the query.
"""

from __future__ import annotations

import datetime as _dt
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import Row
from pyspark.sql.streaming.stateful_processor import (
    ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues,
)

cloudpickle.register_pickle_by_value(sys.modules[__name__])

NS_PER_MS = 1_000_000

# One value per auction: the auction and its best valid bid so far (bid
# fields null until there is one). Each state access is a call from the
# Python worker to the state store, so the processor reads it once per key
# and micro-batch and writes it only when it changes.
AUCTION_STATE = ("reserve long, a_t long, expires_ns long, seller long, category long, "
                 "bidder long, price long, b_t long")
BID_STATE = "bidder long, price long, b_t long"

# Bids of an unknown auction that go to the state together.
EARLY_LOT = 1000

CLOSING_INPUT = ("key long, kind string, reserve long, a_t long, expires_ns long, seller long, "
                 "category long, bidder long, price long, b_t long")
# `event_time` is the watermark at which the result became final: later
# stateful operators in the same query never see it as late.
CLOSED_OUTPUT = ("auction long, category long, seller long, expires_ns long, bidder long, price long, "
                 "bid_time_ns long, event_time timestamp")

_EPOCH = _dt.datetime(1970, 1, 1, tzinfo=_dt.timezone.utc)


def _better(b, best) -> bool:
    """Winner order: higher price, then earlier time, then lower bidder."""
    if best is None:
        return True
    return (b[1], -b[2], -b[0]) > (best[1], -best[2], -best[0])


def _valid(b, a) -> bool:
    bidder, price, b_t = b
    reserve, a_t, expires_ns = a[0], a[1], a[2]
    return price >= reserve and a_t <= b_t < expires_ns


class ClosingProcessor(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("auction", AUCTION_STATE)
        self.early = handle.getListState("early", BID_STATE)
        self.purge = handle.getValueState("purge", "at_ms long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        st = self.state.get()
        best = st[5:] if st is not None and st[5] is not None else None
        changed, waiting, latest = False, [], None
        for r in rows:
            if r.kind == "A":
                if st is None:
                    st, changed = (r.reserve, r.a_t, r.expires_ns, r.seller, r.category), True
                continue
            b = (r.bidder, r.price, r.b_t)
            if st is not None:
                if _valid(b, st) and _better(b, best):
                    best, changed = b, True
                continue
            # The auction is not known yet: bids go to the state in small lots.
            waiting.append(b)
            latest = b[2] if latest is None else max(latest, b[2])
            if len(waiting) >= EARLY_LOT:
                self.early.appendList(waiting)
                waiting = []
        if st is None:
            if waiting:
                self.early.appendList(waiting)
            # One timer a key: it purges what is past and, if later bids have
            # come, sets the next one.
            if latest is not None and not self.purge.exists():
                self._purge_at(latest // NS_PER_MS + 1)
            return iter([])
        if changed and len(st) == 5:  # the auction has just come
            for b in self.early.get():
                if _valid(tuple(b), st) and _better(tuple(b), best):
                    best = tuple(b)
            self.early.clear()
            # close once the watermark reaches expires (timers are in ms)
            self.handle.registerTimer(-(-st[2] // NS_PER_MS))
            for b in waiting:
                if _valid(b, st) and _better(b, best):
                    best = b
        if changed:
            self.state.update(tuple(st[:5]) + (tuple(best) if best else (None, None, None)))
        return iter([])

    def _purge_at(self, ms: int) -> None:
        self.purge.update((ms,))
        self.handle.registerTimer(ms)

    def handleExpiredTimer(self, key, timerValues: TimerValues,
                           expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        fired_ns = expiredTimerInfo.getExpiryTimeInMs() * NS_PER_MS
        st = self.state.get()
        if st is not None:
            if fired_ns < st[2]:
                return iter([])  # the early bids' purge timer; the auction decides now
            self.state.clear()  # early bids were folded in when the auction came
            if st[5] is None:
                return iter([])
            final = _EPOCH + _dt.timedelta(milliseconds=timerValues.getCurrentWatermarkInMs())
            return iter([Row(auction=key[0], category=st[4], seller=st[3], expires_ns=st[2],
                             bidder=st[5], price=st[6], bid_time_ns=st[7], event_time=final)])
        self.purge.clear()
        keep = [tuple(b) for b in self.early.get() if b[2] >= fired_ns]
        self.early.clear()
        if keep:
            self.early.appendList(keep)
            self._purge_at(max(b[2] for b in keep) // NS_PER_MS + 1)
        return iter([])

    def close(self) -> None:
        pass


class RunningMeanProcessor(StatefulProcessor):
    """Per key: (key, auction, expires_ns, avg_price) with the mean of all prices so far."""

    def __init__(self, key_name: str = "category", ttl_ms: int | None = None):
        self.key_name, self.ttl_ms = key_name, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.acc = handle.getValueState("acc", "total long, n long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        total, n = self.acc.get() if self.acc.exists() else (0, 0)
        out = []
        for r in sorted(rows, key=lambda r: (r.expires_ns, r.auction)):
            total, n = total + r.price, n + 1
            out.append(Row(**{self.key_name: key[0]}, auction=r.auction, expires_ns=r.expires_ns,
                           avg_price=total // n))
        self.acc.update((total, n))
        return iter(out)

    def close(self) -> None:
        pass


class LastKMeanProcessor(StatefulProcessor):
    """Per key: (key, auction, expires_ns, avg_price) over the last k prices."""

    def __init__(self, key_name: str = "bidder", k: int = 10, ttl_ms: int | None = None):
        self.key_name, self.k, self.ttl_ms = key_name, k, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tail = handle.getValueState("tail", "prices array<long>", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        tail = list(self.tail.get()[0]) if self.tail.exists() else []
        out = []
        for r in sorted(rows, key=lambda r: (r.expires_ns, r.auction)):
            tail = (tail + [r.price])[-self.k:]
            out.append(Row(**{self.key_name: key[0]}, auction=r.auction, expires_ns=r.expires_ns,
                           avg_price=sum(tail) // len(tail)))
        self.tail.update((tail,))
        return iter(out)

    def close(self) -> None:
        pass
