from gavel.sources.tables import AuctionTables, dense_bids, from_tpch  # noqa: F401
from gavel.sources.events import (  # noqa: F401
    demux, event_accessors, events_from_json, events_to_json, to_events,
)
