"""All registered queries: importing the modules fills the registry."""

from lemmary.plans import graph_queries, more_queries, mutation_queries, stat_queries, text_queries  # noqa: F401
from lemmary.plans.registry import ORACLES, QUERIES  # noqa: F401
