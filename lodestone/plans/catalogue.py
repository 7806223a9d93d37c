"""All queries of the engine by name, and their SQL."""

from __future__ import annotations

from . import flow_queries, graph_queries, read_queries, source_queries, text_queries  # noqa: F401 (they register their queries)
from .queries import ORACLE_SQL, QUERIES, zscore_anomalies

__all__ = ["ORACLE_SQL", "QUERIES", "zscore_anomalies"]
