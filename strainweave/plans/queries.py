"""All core queries: importing the modules registers them."""

from strainweave.plans import analysis_queries, graph_queries, problem_queries  # noqa: F401
from strainweave.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
