"""The registered queries of the provenance operators; importing fills the registry."""

from . import alarm_queries, detector_queries, dsl_queries, graph_queries, more_queries, novelty_queries, resolve_queries, segment_queries, stream_queries, join_tree_queries, learner_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
