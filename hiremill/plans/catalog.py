"""Imports every query module so that the registry is complete."""

from hiremill.plans import queries_basic, queries_board, queries_eval, queries_review, queries_text  # noqa: F401
from hiremill.plans.base import ORACLES, QUERIES  # noqa: F401
