"""Importing this module registers every query."""

from formline.plans import q_audits, q_history, q_models, q_ratings, q_scalar, q_streams, q_tables  # noqa: F401
from formline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
