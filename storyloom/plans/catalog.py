"""The registered queries and their SQL."""

from .queries import QUERIES
from .sql import ORACLE_SQL

FLAGSHIP = "q_top_stories"
__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
