"""All registered queries and checks."""

from threadlens.plans import count_queries, frame_queries, label_queries, scan_queries, score_queries, text_queries
from threadlens.plans.catalog import CHECKS, PLANS

__all__ = [
    "CHECKS",
    "PLANS",
    "count_queries",
    "frame_queries",
    "label_queries",
    "scan_queries",
    "score_queries",
    "text_queries",
]
