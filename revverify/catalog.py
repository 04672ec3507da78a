"""All queries of the engine: importing their modules registers them."""

from __future__ import annotations

from . import queries_features, queries_layout, queries_more, queries_outputs, queries_policy, queries_reports, queries_streams, queries_targets
from .queries import FLAGSHIP
from .registry import ORACLES, QUERIES

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES", "queries_features", "queries_layout", "queries_more", "queries_outputs", "queries_policy", "queries_reports", "queries_streams", "queries_targets"]
