"""Independent DuckDB SQL for every registered query.

Each statement builds the adapter views itself from the shared tables and
states the query's meaning directly in SQL (windows by range predicates,
winners by row_number), so it checks the Spark plans rather than repeating
them.
"""

from __future__ import annotations

from gavel.schema import AUCTION, BID, PERSON
from gavel.sources.tables import US_CITIES, US_STATES

_NS_DAY = 86_400_000_000_000
_NS_S = 1_000_000_000


def _list(xs):
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


VIEWS = f"""
person AS (
  SELECT c_custkey AS id, c_name AS name, '' AS email_address, '' AS credit_card,
         {_list(US_CITIES)}[c_nationkey % 10 + 1] AS city,
         {_list(US_STATES)}[c_nationkey % 6 + 1] AS state,
         epoch_ns(TIMESTAMP '1995-01-01') + ((c_custkey * 7919) % 2400) * {_NS_DAY} AS date_time_ns
  FROM customer),
auction AS (
  SELECT o_orderkey AS id, '' AS item_name, '' AS description,
         CAST(round(o_totalprice * 100) AS BIGINT) // 40 AS initial_bid,
         CAST(round(o_totalprice * 100) AS BIGINT) // 20 AS reserve,
         epoch_ns(o_orderdate) AS date_time_ns,
         epoch_ns(o_orderdate) + (1 + o_orderkey % 90) * {_NS_DAY} AS expires_ns,
         o_custkey AS seller, 10 + o_orderkey % 5 AS category
  FROM orders),
bid AS (
  SELECT l_orderkey AS auction, l_suppkey AS bidder,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS price,
         epoch_ns(l_shipdate) + CAST(l_linenumber AS BIGINT) * {_NS_S} AS date_time_ns
  FROM lineitem),
ebid AS (
  SELECT 1000 + CAST(props->>'$.k' AS BIGINT) AS auction, user_id AS bidder,
         CAST(round(value * 100) AS BIGINT) AS price, epoch_ns(ts) AS date_time_ns
  FROM events),
closed AS (
  SELECT a.id AS auction, a.category, a.seller, a.expires_ns, b.bidder, b.price,
         b.date_time_ns AS bid_time_ns
  FROM auction a JOIN bid b
    ON b.auction = a.id AND b.price >= a.reserve
   AND a.date_time_ns <= b.date_time_ns AND b.date_time_ns < a.expires_ns
  QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY b.price DESC, b.date_time_ns, b.bidder) = 1)
"""


def _with(body: str) -> str:
    return f"WITH {VIEWS.strip()}\n{body.strip()}"


_DUCK_TYPE = {"LongType()": "BIGINT", "StringType()": "VARCHAR"}


def _flat_events() -> str:
    kinds = (("person", PERSON, "Person"), ("auction", AUCTION, "Auction"), ("bid", BID, "Bid"))
    parts = []
    for kind, _, tag in kinds:
        cols = [f"'{tag}' AS type"]
        for other, schema, _ in kinds:
            for f in schema.fields:
                name = f"{other}_{f.name}"
                if other == kind:
                    cols.append(f"{f.name} AS {name}")
                else:
                    cols.append(f"CAST(NULL AS {_DUCK_TYPE[repr(f.dataType)]}) AS {name}")
        parts.append(f"SELECT {', '.join(cols)} FROM {kind}")
    return "\nUNION ALL\n".join(parts)


def _q5_ctes(size_ns: int, slide_ns: int) -> str:
    slices = size_ns // slide_ns
    return f"""
, w AS (
  SELECT DISTINCT (date_time_ns // {slide_ns}) * {slide_ns} + (1 + i) * {slide_ns} AS window_end_ns
  FROM ebid, range(0, {slices}) r(i)),
c AS (
  SELECT w.window_end_ns, b.auction, count(*) AS n
  FROM w JOIN ebid b ON b.date_time_ns >= w.window_end_ns - {size_ns} AND b.date_time_ns < w.window_end_ns
  GROUP BY w.window_end_ns, b.auction),
top AS (
  SELECT window_end_ns, auction, n FROM c
  QUALIFY row_number() OVER (PARTITION BY window_end_ns ORDER BY n DESC, auction DESC) = 1)
"""


def _q5(size_ns: int, slide_ns: int) -> str:
    return _with(_q5_ctes(size_ns, slide_ns) + "SELECT * FROM top")


_H = 3_600 * _NS_S

ORACLE_SQL: dict[str, str] = {
    "q0_passthrough": _with(_flat_events()),
    "demux_person": _with("SELECT * FROM person"),
    "demux_auction": _with("SELECT * FROM auction"),
    "demux_bid": _with("SELECT * FROM bid"),
    "event_accessors": _with("""
SELECT 'Person' AS type, id, date_time_ns AS time_ns FROM person
UNION ALL SELECT 'Auction', id, date_time_ns FROM auction
UNION ALL SELECT 'Bid', auction, date_time_ns FROM bid"""),
    "events_json_roundtrip": _with(_flat_events()),
    "q1_currency": _with("SELECT auction, bidder, (price * 89) // 100 AS price, date_time_ns FROM bid"),
    "q2_selection": _with("SELECT auction, price FROM bid WHERE auction % 123 = 0"),
    "q3_local_items": _with("""
SELECT p.name, p.city, p.state, a.id AS auction_id
FROM auction a JOIN person p ON a.seller = p.id
WHERE a.category = 10 AND p.state IN ('OR', 'ID', 'CA')"""),
    "closed_auctions": _with("SELECT * FROM closed"),
    "q4_category_avg": _with("""
SELECT category, CAST(sum(price) // count(*) AS BIGINT) AS avg_price FROM closed GROUP BY category"""),
    "q4_running_avg": _with("""
SELECT category, auction, expires_ns,
       CAST(sum(price) OVER w // count(*) OVER w AS BIGINT) AS avg_price
FROM closed
WINDOW w AS (PARTITION BY category ORDER BY expires_ns, auction
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""),
    "q5_hot_items": _q5(_H, 600 * _NS_S),
    "q5_hot_items_panes": _q5(_H, 600 * _NS_S),
    "q5_hot_items_deltas": _q5(_H, 60 * _NS_S),
    "q6_last10_bidder": _with("""
SELECT bidder, auction, expires_ns,
       CAST(sum(price) OVER w // count(*) OVER w AS BIGINT) AS avg_price
FROM closed
WINDOW w AS (PARTITION BY bidder ORDER BY expires_ns, auction ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"""),
    "q6_last10_seller": _with("""
SELECT seller, auction, expires_ns,
       CAST(sum(price) OVER w // count(*) OVER w AS BIGINT) AS avg_price
FROM closed
WINDOW w AS (PARTITION BY seller ORDER BY expires_ns, auction ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"""),
    "q7_highest_bid": _with(f"""
SELECT (date_time_ns // {_H}) * {_H} + {_H} AS window_end_ns, max(price) AS price
FROM ebid GROUP BY 1"""),
    "q7_highest_bid_10s": _with(f"""
SELECT (date_time_ns // {10 * _NS_S}) * {10 * _NS_S} + {10 * _NS_S} AS window_end_ns, max(price) AS price
FROM bid GROUP BY 1"""),
    "q8_new_users": _with(f"""
SELECT p.id, a.id AS auction_id FROM auction a JOIN person p
  ON a.seller = p.id AND p.date_time_ns <= a.date_time_ns AND a.date_time_ns < p.date_time_ns + {12 * _H}"""),
    "q8_new_users_30d": _with(f"""
SELECT p.id, a.id AS auction_id FROM auction a JOIN person p
  ON a.seller = p.id AND p.date_time_ns <= a.date_time_ns AND a.date_time_ns < p.date_time_ns + {30 * 24 * _H}"""),
    "q8_as_written": _with(f"""
SELECT o.id, a.id AS auction_id FROM auction a JOIN auction o
  ON a.seller = o.id AND a.date_time_ns < o.date_time_ns + {12 * _H}"""),
}


_SAMPLES = """
, s AS (SELECT epoch_ns(ts) AS t_ns, CAST(round(value * 100) AS BIGINT) AS latency_ns FROM events)
"""

def _diff(left: str, right: str, cols: str) -> str:
    """Rows that one of two relations holds more often, and how many times more."""
    return f"""
, l_ AS (SELECT {cols}, count(*) AS n_ FROM {left} GROUP BY ALL),
r_ AS (SELECT {cols}, count(*) AS m_ FROM {right} GROUP BY ALL)
SELECT CASE WHEN coalesce(n_, 0) > coalesce(m_, 0) THEN 'left' ELSE 'right' END AS side, {cols},
       abs(coalesce(n_, 0) - coalesce(m_, 0)) AS n_more
FROM l_ FULL JOIN r_ USING ({cols}) WHERE coalesce(n_, 0) <> coalesce(m_, 0)"""


_Q7_10S = f"SELECT (date_time_ns // {10 * _NS_S}) * {10 * _NS_S} + {10 * _NS_S} AS window_end_ns, max(price) AS price"


ORACLE_SQL.update({
    "latency_ccdf": _with(_SAMPLES + """
, h AS (SELECT latency_ns - latency_ns % 100 AS latency, count(*) AS samples FROM s GROUP BY 1)
SELECT latency,
       CAST(sum(samples) OVER (ORDER BY latency DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE)
         / (SELECT count(*) FROM s) AS ccdf,
       samples
FROM h"""),
    "latency_timeline": _with(_SAMPLES + f"""
, b AS (SELECT (t_ns // {_H}) * {_H} + {_H} AS slot_end_ns, latency_ns - latency_ns % 100 AS b FROM s)
SELECT slot_end_ns, quantile_disc(b, 0.25) AS p25, quantile_disc(b, 0.5) AS p50, quantile_disc(b, 0.75) AS p75,
       quantile_disc(b, 0.95) AS p95, quantile_disc(b, 0.99) AS p99, quantile_disc(b, 0.999) AS p999,
       max(b) AS max, count(*) AS samples
FROM b GROUP BY slot_end_ns"""),
    "diff_q5_forms": _with(_q5_ctes(_H, 600 * _NS_S) + _diff("top", "top", "window_end_ns, auction, n")),
    "diff_q7_currency": _with(f"""
, a AS ({_Q7_10S} FROM bid GROUP BY 1),
b AS ({_Q7_10S} FROM (SELECT auction, bidder, (price * 89) // 100 AS price, date_time_ns FROM bid) GROUP BY 1)
""" + _diff("a", "b", "window_end_ns, price")),
    "diff_repeated_rows": _with(f"""
, a AS (SELECT (date_time_ns // {_H}) * {_H} + {_H} AS window_end_ns, auction % 4 AS v FROM ebid),
b AS (SELECT (date_time_ns // {_H}) * {_H} + {_H} AS window_end_ns, bidder % 4 AS v FROM ebid)
""" + _diff("a", "b", "window_end_ns, v")),
    "latency_ccdf_trimmed": _with(_SAMPLES + f"""
, kept AS (SELECT latency_ns FROM s, (SELECT min(t_ns) AS lo, max(t_ns) + 1 AS hi FROM s)
  WHERE t_ns >= lo + {2 * 24 * _H} AND t_ns < hi - {2 * 24 * _H}),
e AS (SELECT latency_ns, greatest(length(ltrim(bin(latency_ns), '0')) - 5, 0) AS shift FROM kept),
h AS (SELECT (latency_ns >> shift) << shift AS latency, count(*) AS samples FROM e GROUP BY 1)
SELECT latency,
       CAST(sum(samples) OVER (ORDER BY latency DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE)
         / (SELECT count(*) FROM kept) AS ccdf,
       samples
FROM h"""),
    "latency_report_lines": _with(_SAMPLES + f"""
, b AS (SELECT (t_ns // {_H}) * {_H} + {_H} AS slot_end_ns, latency_ns - latency_ns % 100 AS b FROM s)
SELECT concat_ws(chr(9), 'summary_timeline', slot_end_ns, quantile_disc(b, 0.25), quantile_disc(b, 0.5),
  quantile_disc(b, 0.75), quantile_disc(b, 0.95), quantile_disc(b, 0.99), quantile_disc(b, 0.999), max(b)) AS value
FROM b GROUP BY slot_end_ns"""),
})


# Streaming forms: what the batch form gives, as far as the watermark (whole
# milliseconds, the latest event time, the least of several inputs') closes it.
def _ms(ns: str) -> str:
    return f"({ns}) // 1000000 * 1000000"


_EVENTS_MARK = f"(SELECT {_ms('max(date_time_ns)')} FROM ebid)"
# Closing by sessions runs on a clock of three ticks a ns, whose watermark moves in steps of 1,000 ticks: a session ends
# one tick before three times the expiry; the latest bid begins one tick after three times its time.
_SESSION_OVER = ("3 * expires_ns - 1 <= greatest((SELECT 3 * max(date_time_ns) + 1 FROM bid), "
                 "(SELECT 3 * max(date_time_ns) FROM auction)) // 1000 * 1000")
# Bounded closing: bids' watermark, and the latest close time (expiry + 1 ms)
# less the length bound + 1 ms. An auction leaves with the 1 ms window of its close time, once
# the watermark that the join hands on, less by the range of its condition, has passed it.
_BOUNDED_MARK = (f"least((SELECT {_ms('max(date_time_ns)')} FROM bid), "
                 f"(SELECT {_ms('max(expires_ns)')} FROM auction) - {90 * 24 * _H})")
_BOUNDED = f", done AS (SELECT * FROM closed WHERE expires_ns + 2000000 <= {_BOUNDED_MARK} - {90 * 24 * _H + 1000000})\n"

_DONE = f", done AS (SELECT * FROM closed WHERE {_SESSION_OVER})\n"

ORACLE_SQL.update({
    "q3_stream": ORACLE_SQL["q3_local_items"],
    "q5_stream": _with(_q5_ctes(_H, 600 * _NS_S) + f"SELECT * FROM top WHERE window_end_ns <= {_EVENTS_MARK}"),
    "q7_stream": _with(f"""
SELECT * FROM (SELECT (date_time_ns // {_H}) * {_H} + {_H} AS window_end_ns, max(price) AS price FROM ebid GROUP BY 1)
WHERE window_end_ns <= {_EVENTS_MARK}"""),
    "q8_stream": ORACLE_SQL["q8_new_users_30d"],
    "q8_as_written_stream": ORACLE_SQL["q8_as_written"],
    "closed_auctions_stream": _with(f"SELECT * FROM closed WHERE {_SESSION_OVER}"),
    "closed_auctions_table_stream": _with(f"SELECT * FROM closed WHERE {_SESSION_OVER}"),
    "closed_auctions_bounded_stream": _with(_BOUNDED + "SELECT * FROM done"),
    "q4_running_stream": _with(_DONE + """
SELECT category, auction, expires_ns,
       CAST(sum(price) OVER w // count(*) OVER w AS BIGINT) AS avg_price
FROM done
WINDOW w AS (PARTITION BY category ORDER BY expires_ns, auction
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""),
    "q6_stream": _with(_DONE + """
SELECT bidder, auction, expires_ns,
       CAST(sum(price) OVER w // count(*) OVER w AS BIGINT) AS avg_price
FROM done
WINDOW w AS (PARTITION BY bidder ORDER BY expires_ns, auction ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"""),
})


def _late(delay_us: int, batches: int = 20) -> str:
    """Q7 over bids in bounded disorder: the arrival order is stated forwards (place p holds row p div n * n + p * 953
    mod n), and a row is late by the watermark of the micro-batch before its own."""
    return _with(f"""
, k AS (SELECT count(*) AS rows, (count(*) + {batches - 1}) // {batches} AS size FROM ebid),
g AS (SELECT rows, size, CASE WHEN (3 * size + 1) % 953 = 0 THEN 3 * size + 2 ELSE 3 * size + 1 END AS n FROM k),
places AS (SELECT p, CASE WHEN p < rows // n * n THEN p // n * n + (p * 953) % n ELSE p END AS number, p // size AS file
  FROM g, range(0, rows) r(p)),
rows_ AS (SELECT price, date_time_ns, row_number() OVER (ORDER BY date_time_ns) - 1 AS number FROM ebid),
fed AS (SELECT price, date_time_ns, dense_rank() OVER (ORDER BY file) AS batch FROM rows_ JOIN places USING (number)),
marks AS (SELECT batch, max(date_time_ns) // 1000000 * 1000 - {delay_us} AS mark_us FROM fed GROUP BY batch),
told AS (SELECT batch, max(mark_us) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) AS mark_us FROM marks),
judged AS (SELECT price, date_time_ns, date_time_ns // 1000 <= coalesce(mark_us, 0) AS late FROM fed JOIN told USING (batch))
SELECT 'window' AS what, window_end_ns, value FROM (
  SELECT (date_time_ns // {_H}) * {_H} + {_H} AS window_end_ns, max(price) AS value FROM judged WHERE NOT late GROUP BY 1)
WHERE window_end_ns <= (SELECT max(mark_us) * 1000 FROM marks)
UNION ALL SELECT 'dropped', NULL, count(*) FROM judged WHERE late""")


_MEAN = "CAST(sum(price) OVER w // count(*) OVER w AS BIGINT) AS avg_price"
_LOG_LINEAR = "(latency_ns >> greatest(length(ltrim(bin(latency_ns), '0')) - 5, 0)) << greatest(length(ltrim(bin(latency_ns), '0')) - 5, 0)"
_DENSE_Q7 = f"SELECT (date_time_ns // {_H}) * {_H} + {_H} AS window_end_ns, max(price) AS price"

ORACLE_SQL.update({
    "q3_latest_registration": _with("""
, p AS (SELECT CASE WHEN id % 3 = 0 THEN 0 ELSE id // 4 + 1 END AS id, name, city, state, date_time_ns FROM person),
a AS (SELECT id AS auction_id, CASE WHEN seller % 3 = 0 THEN 0 ELSE seller // 4 + 1 END AS seller, date_time_ns FROM auction WHERE category = 10),
m AS (SELECT p.name, p.city, p.state, a.auction_id FROM a JOIN p ON a.seller = p.id AND p.date_time_ns <= a.date_time_ns
  QUALIFY row_number() OVER (PARTITION BY a.auction_id ORDER BY p.date_time_ns DESC, p.name DESC, p.city DESC, p.state DESC) = 1)
SELECT * FROM m WHERE state IN ('OR', 'ID', 'CA')"""),
    "q4_q6_shared_stream": _with(_DONE + f"""
SELECT 'q4' AS query, category AS key, auction, expires_ns, {_MEAN} FROM done
WINDOW w AS (PARTITION BY category ORDER BY expires_ns, auction ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
UNION ALL
SELECT 'q6', bidder, auction, expires_ns, {_MEAN} FROM done
WINDOW w AS (PARTITION BY bidder ORDER BY expires_ns, auction ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"""),
    "q4_update_stream": _with(_DONE + "SELECT category, CAST(sum(price) // count(*) AS BIGINT) AS avg_price FROM done GROUP BY category"),
    "diff_q5_stream": _with(_q5_ctes(_H, 600 * _NS_S) + f", over AS (SELECT * FROM top WHERE window_end_ns <= {_EVENTS_MARK})"
                            + _diff("over", "over", "window_end_ns, auction, n")),
    "diff_q7_stream": _with(f"""
, a AS (SELECT * FROM ({_DENSE_Q7} FROM ebid GROUP BY 1) WHERE window_end_ns <= {_EVENTS_MARK}),
b AS (SELECT * FROM ({_DENSE_Q7} FROM (SELECT (price * 89) // 100 AS price, date_time_ns FROM ebid) GROUP BY 1) WHERE window_end_ns <= {_EVENTS_MARK})
""" + _diff("a", "b", "window_end_ns, price")),
    "late_rows_stream": _late(3_600 * 10**6),
    "late_rows_none_stream": _late(8 * 24 * 3_600 * 10**6),
    "latency_timeline_stream": _with(_SAMPLES + f"""
, b AS (SELECT (t_ns // {_H}) * {_H} + {_H} AS slot_end_ns, {_LOG_LINEAR} AS b FROM s)
SELECT slot_end_ns, quantile_disc(b, 0.25) AS p25, quantile_disc(b, 0.5) AS p50, quantile_disc(b, 0.75) AS p75,
       quantile_disc(b, 0.95) AS p95, quantile_disc(b, 0.99) AS p99, quantile_disc(b, 0.999) AS p999,
       max(b) AS max, count(*) AS samples
FROM b WHERE slot_end_ns <= (SELECT {_ms('max(t_ns)')} FROM s) GROUP BY slot_end_ns"""),
    "latency_ccdf_stream": _with(_SAMPLES + f"""
, h AS (SELECT {_LOG_LINEAR} AS latency, count(*) AS samples FROM s GROUP BY 1)
SELECT latency, CAST(sum(samples) OVER (ORDER BY latency DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE)
         / (SELECT count(*) FROM s) AS ccdf, samples
FROM h"""),
})
