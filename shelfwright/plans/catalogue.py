"""All registered queries."""

from shelfwright.plans import (  # noqa: F401
    ops_queries,
    page_queries,
    product_queries,
    store_queries,
    stream_queries,
    url_queries,
)
from shelfwright.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
