"""All queries of the lifecycle operators."""

from . import more_queries  # noqa: F401  it registers its queries
from .queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
