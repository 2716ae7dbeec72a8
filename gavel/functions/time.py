"""Time helpers: nanosecond LONG columns, event-time timestamps, window labels."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

NS_PER_US = 1_000
NS_PER_SECOND = 1_000_000_000
NS_PER_MINUTE = 60 * NS_PER_SECOND
NS_PER_HOUR = 60 * NS_PER_MINUTE
NS_PER_DAY = 24 * NS_PER_HOUR

_UNITS = {
    "ns": 1, "nanosecond": 1, "nanoseconds": 1,
    "us": NS_PER_US, "microsecond": NS_PER_US, "microseconds": NS_PER_US,
    "ms": 1_000_000, "millisecond": 1_000_000, "milliseconds": 1_000_000, "s": NS_PER_SECOND,
    "second": NS_PER_SECOND, "seconds": NS_PER_SECOND,
    "m": NS_PER_MINUTE, "min": NS_PER_MINUTE, "minute": NS_PER_MINUTE, "minutes": NS_PER_MINUTE,
    "h": NS_PER_HOUR, "hour": NS_PER_HOUR, "hours": NS_PER_HOUR,
    "d": NS_PER_DAY, "day": NS_PER_DAY, "days": NS_PER_DAY,
}


def duration_ns(spec: int | str) -> int:
    """`"10 minutes"`, `"12h"`, `"60 s"` or a plain int (ns) -> nanoseconds."""
    if isinstance(spec, int):
        return spec
    m = re.fullmatch(r"\s*(\d+)\s*([a-z]+)\s*", spec.lower())
    if not m or m.group(2) not in _UNITS:
        raise ValueError(f"cannot read duration {spec!r}")
    return int(m.group(1)) * _UNITS[m.group(2)]


def ns_of(ts: str, local: bool = False) -> Column:
    """Timestamp column (by name) -> LONG ns since the epoch.

    TIMESTAMP_NTZ (the default) is read as wall time in UTC, independent of
    the session zone; `local=True` takes a TIMESTAMP (instant) via unix_micros.
    """
    if local:
        return F.unix_micros(F.col(ts)) * F.lit(NS_PER_US)
    q = "`" + ts.replace("`", "``") + "`"
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {q})") * F.lit(NS_PER_US)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def idiv(a: Column | str, b: Column | int) -> Column:
    """Integer division (SQL `div`), exact on LONG; never through DOUBLE."""
    return F.call_function("div", _col(a), b if isinstance(b, Column) else F.lit(b))


def floor_to(ns: Column | str, size_ns: int) -> Column:
    """Largest multiple of `size_ns` at or below `ns` (exact, also for negatives)."""
    c = _col(ns)
    return c - F.pmod(c, F.lit(size_ns))


def event_time(ns: Column | str) -> Column:
    """LONG ns -> TIMESTAMP (µs precision) for watermarks and window()."""
    return F.timestamp_micros(idiv(floor_to(ns, NS_PER_US), NS_PER_US))


def window_end_ns(ns: Column | str, size_ns: int) -> Column:
    """Label of the tumbling window holding time `ns`: its exclusive end.

    A row exactly on a boundary belongs to the later window, as with window().
    """
    return floor_to(ns, size_ns) + F.lit(size_ns)
