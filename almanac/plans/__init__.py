"""Registered queries (one per inventory item) and their DuckDB oracle SQL."""

from . import cases, oracle, queries
from .queries import finish

QUERIES = {**queries.QUERIES, **cases.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**oracle.SQL, **cases.SQL}


__all__ = ["QUERIES", "finish", "oracle_sql"]
