from gavel.plans.registry import QUERIES, QUERY_INPUTS, entry_query  # noqa: F401
from gavel.plans.oracle import ORACLE_SQL  # noqa: F401
