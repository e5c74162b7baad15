"""The package's named queries."""

from lanewise.plans import corpus_queries, extension_queries, kernel_queries, scoring_queries, tensor_queries, text_queries, trace_queries  # noqa: F401
from lanewise.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
