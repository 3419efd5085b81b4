"""All queries."""

from checks import live, mining, parsing, tables  # noqa: F401
from checks.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
