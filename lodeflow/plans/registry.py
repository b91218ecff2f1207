"""All registered queries but those over the training-data operators."""

from __future__ import annotations

from lodeflow.plans import flow_queries, lake_queries, order_queries
from lodeflow.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flow_queries", "lake_queries", "order_queries"]
