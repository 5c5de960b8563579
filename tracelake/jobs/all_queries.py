"""Importing this module registers all queries of the journal operators."""

from . import agent_queries, audit_queries, graph_queries, page_queries, projection_queries, stream_queries, workflow_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
