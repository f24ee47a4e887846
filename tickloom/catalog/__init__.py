"""Runnable queries over the given tables, one or more per operator."""

from tickloom.catalog import files, market, modelling, ordered, scalar, streams  # noqa: F401
from tickloom.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
