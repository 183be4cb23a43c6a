"""Imports every query module so that the registry is complete."""

from postsift.plans import group_queries, model_queries, row_queries, score_queries, sender_queries, text_queries  # noqa: F401
from postsift.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
