"""Queries over the driver tables, by inventory key."""

from . import (  # noqa: F401
    aggregate_queries,
    composite_queries,
    join_queries,
    learn_queries,
    metric_queries,
    quality_queries,
    rank_queries,
    rating_queries,
    scalar_queries,
    source_queries,
    stream_queries,
    window_queries,
)  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
