"""All named ledger queries."""

from . import checks, dates, files, merges, quotas, repairs, reports, texts, underwriting  # noqa: F401  (they add their queries)
from .queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
