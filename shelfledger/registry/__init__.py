"""Registered queries: each operator on the given tables, with its SQL twin."""

from shelfledger.registry.core import QUERIES, Query
from shelfledger.registry import (  # noqa: F401  (registration)
    cost_queries,
    inventory_queries,
    lake_queries,
    profit_queries,
    quality_queries,
    sales_queries,
    shaping_queries,
)

__all__ = ["QUERIES", "Query"]
