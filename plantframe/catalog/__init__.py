"""All registered queries."""

from . import sources, projections, joins, aggregates, ordered, constraints, learning, streams  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
