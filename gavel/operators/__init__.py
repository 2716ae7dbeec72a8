"""Batch operators of the auction queries (all work on DataFrames)."""

from gavel.operators.averages import q4_category_avg, q4_running_avg, q6_last_avg  # noqa: F401
from gavel.operators.basic import q0_passthrough, q1_currency, q2_selection  # noqa: F401
from gavel.operators.closing import closed_auctions  # noqa: F401
from gavel.operators.diff import diff_by_time  # noqa: F401
from gavel.operators.joins import q3_local_items, q8_as_written, q8_new_users  # noqa: F401
from gavel.operators.latency import latency_ccdf, latency_timeline, trim  # noqa: F401
from gavel.operators.running import running_frame  # noqa: F401
from gavel.operators.windows import q5_hot_items, q5_hot_items_by_window, q5_hot_items_panes, q7_highest_bid  # noqa: F401
