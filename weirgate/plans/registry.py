"""All registered queries of the library and their SQL."""

from . import stream_queries  # noqa: F401  registers its queries
from .queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
