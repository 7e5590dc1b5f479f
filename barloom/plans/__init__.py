from barloom.plans import (  # noqa: F401
    data_queries, feature_queries, strategy_queries, stream_queries,
)
from barloom.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
