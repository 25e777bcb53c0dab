"""The registered queries and their DuckDB texts."""

from . import parsing, traffic, security, analysis, streams  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
