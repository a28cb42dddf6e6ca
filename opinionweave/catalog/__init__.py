"""Queries over the test tables: one per operator, each with its SQL statement where one exists."""

from .registry import QUERIES, SQL
from . import governance_queries, index_queries, integrity_queries, signal_queries, stream_queries, survey_queries  # noqa: F401

__all__ = ["QUERIES", "SQL"]
