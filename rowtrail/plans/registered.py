"""All registered queries."""

from rowtrail.plans import (  # noqa: F401
    aggregate_queries, boost_queries, cases, feature_queries, fuzzy_queries, join_queries, lineage_queries, row_queries, sample_queries,
    weighted_queries,
)
from rowtrail.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
