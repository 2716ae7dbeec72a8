"""Row schemas of the auction model and the tagged event union.

Times are LONG nanoseconds since the epoch (``*_ns``), prices integer cents;
all arithmetic on them is integer (``div``), never floating point.
"""

from pyspark.sql import types as T

L, S = T.LongType(), T.StringType()

PERSON = T.StructType([
    T.StructField("id", L, True),
    T.StructField("name", S, True),
    T.StructField("email_address", S, True),
    T.StructField("credit_card", S, True),
    T.StructField("city", S, True),
    T.StructField("state", S, True),
    T.StructField("date_time_ns", L, True),
])

AUCTION = T.StructType([
    T.StructField("id", L, True),
    T.StructField("item_name", S, True),
    T.StructField("description", S, True),
    T.StructField("initial_bid", L, True),
    T.StructField("reserve", L, True),
    T.StructField("date_time_ns", L, True),
    T.StructField("expires_ns", L, True),
    T.StructField("seller", L, True),
    T.StructField("category", L, True),
])

BID = T.StructType([
    T.StructField("auction", L, True),
    T.StructField("bidder", L, True),
    T.StructField("price", L, True),
    T.StructField("date_time_ns", L, True),
])

# Tagged union: exactly one of the three structs is set, named by `type`.
EVENT = T.StructType([
    T.StructField("type", S, True),
    T.StructField("person", PERSON, True),
    T.StructField("auction", AUCTION, True),
    T.StructField("bid", BID, True),
])

EVENT_TYPES = ("Person", "Auction", "Bid")

# Closed auction with its winning bid, flat.
CLOSED = T.StructType([
    T.StructField("auction", L, True),
    T.StructField("category", L, True),
    T.StructField("seller", L, True),
    T.StructField("expires_ns", L, True),
    T.StructField("bidder", L, True),
    T.StructField("price", L, True),
    T.StructField("bid_time_ns", L, True),
    T.StructField("event_time", T.TimestampType(), True),
])

PERSON_COLS = [f.name for f in PERSON.fields]
AUCTION_COLS = [f.name for f in AUCTION.fields]
BID_COLS = [f.name for f in BID.fields]
