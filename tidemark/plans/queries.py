"""All queries of the engine."""

from . import analytics_queries, brief_queries, enrich_queries, history_queries, record_queries, render_queries, review_queries, rule_queries, store_queries, stream_queries, text_queries  # noqa: F401
from .catalog import COVERS, ORACLES, QUERIES

flagship = record_queries.flagship

__all__ = ["COVERS", "ORACLES", "QUERIES", "flagship"]
