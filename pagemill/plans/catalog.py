"""All registered queries of the document-analytics operators."""

from pagemill.plans import cache_queries, rationale_queries, text_queries, token_queries  # noqa: F401
from pagemill.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
