"""The named queries of the engine and their SQL equivalents."""

from __future__ import annotations

from wickframe.plans import more, predicates, queries, reversal_sql, sql, streams
from wickframe.plans.queries import flagship

QUERIES = queries.QUERIES | more.QUERIES | streams.QUERIES | predicates.QUERIES
ORACLE_SQL = sql.ORACLE_SQL | more.ORACLE_SQL | streams.ORACLE_SQL | predicates.ORACLE_SQL | reversal_sql.oracle()

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]
