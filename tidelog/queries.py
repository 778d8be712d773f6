"""The queries by name, and the SQL that they must agree with."""

from .plans import operations  # noqa: F401  registers its queries
from .plans.catalogue import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
