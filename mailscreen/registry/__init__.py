"""Named queries over the given tables, each with the SQL that must agree with it."""

from mailscreen.registry.base import ORACLES, QUERIES
from mailscreen.registry import corpus_queries, evaluation_queries, feature_queries, intake_queries, linear_queries, training_queries, text_queries  # noqa: F401,E501

__all__ = ["ORACLES", "QUERIES"]
