"""Small hand-made relations for unit cases."""

from gavel.schema import AUCTION, BID, PERSON
from gavel.sources.tables import AuctionTables


def auctions(spark, rows):
    """rows: dicts with id, reserve, t, exp and optional seller, category."""
    full = [(r["id"], "", "", 0, r.get("reserve", 0), r["t"], r["exp"], r.get("seller", 1),
             r.get("category", 10)) for r in rows]
    return spark.createDataFrame(full, AUCTION)


def bids(spark, rows):
    """rows: (auction, bidder, price, t)."""
    return spark.createDataFrame(rows, BID)


def persons(spark, rows):
    """rows: (id, state, t)."""
    return spark.createDataFrame([(i, f"p{i}", "", "", "x", s, t) for i, s, t in rows], PERSON)


def tables(spark, person_rows=(), auction_rows=(), bid_rows=()):
    return AuctionTables(persons(spark, list(person_rows)), auctions(spark, list(auction_rows)),
                         bids(spark, list(bid_rows)))
