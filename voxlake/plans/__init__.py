"""Views, jobs and the registered queries."""

from . import geometry_queries, score_queries, source_queries
from .registry import QUERIES, SQL

flagship = QUERIES["agg_07_threshold_sweep_whole"]
__all__ = ["QUERIES", "SQL", "flagship", "geometry_queries", "score_queries", "source_queries"]
