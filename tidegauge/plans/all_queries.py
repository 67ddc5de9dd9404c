"""All registered queries."""

from . import catalogue_queries, reading_queries, series_queries, table_queries  # noqa: F401
from .registry import REGISTRY

__all__ = ["REGISTRY"]
