"""Registered queries and, for each that SQL can express, its SQL."""

from catalog.base import CATALOG
from catalog import (  # noqa: F401
    aggregates,
    cleaning,
    combining,
    decisions,
    learning,
    monitoring,
    relations,
    sourcing,
    statistics,
    streams,
)

__all__ = ["CATALOG"]
