"""Named queries over the bound tables."""

from . import acquisition_plans, claim_plans, dedup_plans, graph_plans, log_plans, more_plans, retrieval_plans, scans, source_plans, stream_plans, texts, view_plans
from .registry import ORACLE_SQL, QUERIES

__all__ = [
    "ORACLE_SQL", "QUERIES", "acquisition_plans", "claim_plans", "dedup_plans", "graph_plans", "log_plans", "more_plans", "retrieval_plans", "scans", "source_plans", "stream_plans", "texts", "view_plans",
]
