"""Importing this module fills the registry."""

from loomline.queries import boost_queries, cell_queries, model_queries, profile_queries, recipe_queries, rollup_queries, round_trips, row_queries  # noqa: F401
from loomline.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
