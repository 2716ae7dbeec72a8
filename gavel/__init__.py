"""gavel: online-auction (people, auctions, bids) analytics on Spark.

Batch queries are DataFrame functions over three relations (person, auction,
bid); streaming forms run the same logic with Structured Streaming.
"""

from gavel.sources.tables import AuctionTables

__all__ = ["AuctionTables"]
