"""All queries of the library by name, and their SQL."""

from quillon.plans import candidates, data, evaluate, scalar  # noqa: F401  they register their queries
from quillon.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
