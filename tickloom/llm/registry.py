"""All queries of this package."""

from tickloom.llm import queries  # noqa: F401
from tickloom.llm.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
