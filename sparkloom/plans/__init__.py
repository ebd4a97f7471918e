"""Named queries over the star-schema tables, with SQL that gives the same rows."""

from . import board_queries, document_queries, flow_queries, graph_queries, queries

__all__ = ["board_queries", "document_queries", "flow_queries", "graph_queries", "queries"]
