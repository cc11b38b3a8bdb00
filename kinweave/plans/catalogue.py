"""Imports every catalogue module so that its queries are registered."""

from kinweave.plans import (  # noqa: F401
    queries_aggregates,
    queries_communities,
    queries_distances,
    queries_graph,
    queries_joins,
    queries_phrases,
    queries_reports,
    queries_rules,
    queries_shape,
    queries_sources,
    queries_tags,
    queries_text,
    queries_windows,
)
from kinweave.plans.registry import ORACLES, QUERIES  # noqa: F401
