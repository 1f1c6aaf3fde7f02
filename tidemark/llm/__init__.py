"""Operators for preparing training data. Nothing else in the library imports this package."""

from tidemark.llm.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
