"""The three auction relations, and their adapter over the shared test tables.

`AuctionTables` is the holder every query takes. `from_tpch` maps the driver's
tables onto it (customer -> person, orders -> auction, lineitem -> bid);
`dense_bids` maps `events` onto bids with a dense clock for window queries.
All mappings are projections, so Catalyst prunes the scan to the columns a
query actually uses.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from gavel.functions.time import NS_PER_DAY, NS_PER_SECOND, NS_PER_US

# The generator's default city and state lists, in order.
US_CITIES = ["phoenix", "los angeles", "san francisco", "boise", "portland",
             "bend", "redmond", "seattle", "kent", "cheyenne"]
US_STATES = ["AZ", "CA", "ID", "OR", "WA", "WY"]

FIRST_CATEGORY = 10
NUM_CATEGORIES = 5
PERSON_EPOCH_NS = int(_dt.datetime(1995, 1, 1, tzinfo=_dt.timezone.utc).timestamp()) * NS_PER_SECOND


@dataclass
class AuctionTables:
    """Named relations of the auction model (any of them may be streaming)."""

    person: DataFrame
    auction: DataFrame
    bid: DataFrame


# Declared schemas of the shared tables this library reads: no footer reads
# for inference on every query.
TABLE_SCHEMAS = {
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "orders": ("o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
               "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING"),
    "lineitem": ("l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
                 "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, "
                 "l_linestatus STRING, l_shipdate TIMESTAMP_NTZ"),
    "events": ("event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, "
               "props STRING"),
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read
    if name in TABLE_SCHEMAS:
        reader = reader.schema(TABLE_SCHEMAS[name])
    return reader.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _sql_list(xs: list[str]) -> str:
    return "array(" + ", ".join("'" + x + "'" for x in xs) + ")"


def _ns(col: str) -> str:
    """SQL text: TIMESTAMP_NTZ column -> LONG ns (zone independent)."""
    return f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {col}) * {NS_PER_US}"


# The adapters are single selectExpr projections: one parse on the JVM side
# instead of a py4j call per column expression.

def person_from_customer(customer: DataFrame) -> DataFrame:
    return customer.selectExpr(
        "c_custkey AS id",
        "c_name AS name",
        "'' AS email_address",
        "'' AS credit_card",
        f"element_at({_sql_list(US_CITIES)}, CAST(pmod(c_nationkey, {len(US_CITIES)}) + 1 AS INT)) AS city",
        f"element_at({_sql_list(US_STATES)}, CAST(pmod(c_nationkey, {len(US_STATES)}) + 1 AS INT)) AS state",
        f"{PERSON_EPOCH_NS}L + pmod(c_custkey * 7919, 2400) * {NS_PER_DAY}L AS date_time_ns",
    )


def auction_from_orders(orders: DataFrame) -> DataFrame:
    cents = "CAST(round(o_totalprice * 100) AS BIGINT)"
    return orders.selectExpr(
        "o_orderkey AS id",
        "'' AS item_name",
        "'' AS description",
        f"{cents} div 40 AS initial_bid",
        f"{cents} div 20 AS reserve",
        f"{_ns('o_orderdate')} AS date_time_ns",
        f"{_ns('o_orderdate')} + (pmod(o_orderkey, 90) + 1) * {NS_PER_DAY}L AS expires_ns",
        "o_custkey AS seller",
        f"{FIRST_CATEGORY} + pmod(o_orderkey, {NUM_CATEGORIES}) AS category",
    )


def bid_from_lineitem(lineitem: DataFrame) -> DataFrame:
    return lineitem.selectExpr(
        "l_orderkey AS auction",
        "l_suppkey AS bidder",
        "CAST(round(l_extendedprice * 100) AS BIGINT) AS price",
        f"{_ns('l_shipdate')} + CAST(l_linenumber AS BIGINT) * {NS_PER_SECOND}L AS date_time_ns",
    )


def from_tpch(spark: SparkSession, sf_dir: str) -> AuctionTables:
    """person / auction / bid over customer / orders / lineitem."""
    return AuctionTables(
        person=person_from_customer(read_table(spark, sf_dir, "customer")),
        auction=auction_from_orders(read_table(spark, sf_dir, "orders")),
        bid=bid_from_lineitem(read_table(spark, sf_dir, "lineitem")),
    )


def bids_from_events(events: DataFrame) -> DataFrame:
    """Bids with a dense, strictly increasing clock (events.ts); auction 1000 + props.k."""
    return events.selectExpr(
        "1000 + CAST(get_json_object(props, '$.k') AS BIGINT) AS auction",
        "user_id AS bidder",
        "CAST(round(value * 100) AS BIGINT) AS price",
        f"{_ns('ts')} AS date_time_ns",
    )


def dense_bids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bids_from_events(read_table(spark, sf_dir, "events"))
