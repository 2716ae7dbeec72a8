from gavel.functions.time import (  # noqa: F401
    NS_PER_DAY, NS_PER_HOUR, NS_PER_MINUTE, NS_PER_SECOND, NS_PER_US,
    duration_ns, event_time, floor_to, idiv, ns_of, window_end_ns,
)
