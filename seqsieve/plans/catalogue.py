"""All registered queries and their SQL counterparts."""

from __future__ import annotations

from seqsieve.plans import geometry_queries, metric_queries, model_queries, selection_queries, sequence_queries  # noqa: F401
from seqsieve.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
