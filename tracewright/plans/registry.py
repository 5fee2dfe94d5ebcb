"""All registered queries."""

from tracewright.plans import (  # noqa: F401
    model_queries,
    result_queries,
    source_queries,
    text_queries,
    trace_queries,
)
from tracewright.plans.catalog import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
