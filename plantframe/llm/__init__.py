"""Operators for training-data corpora."""

from .queries import ORACLES, QUERIES  # noqa: F401
