"""Collects queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the function under its name, with the SQL that DuckDB gives the same rows for."""

    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def round6(c):
    """A double column at six decimals, halves away from 0, as DuckDB's round has it: Spark's own writes each number out as text and reads it back."""
    from pyspark.sql import functions as F

    whole = F.when(c < 0, F.ceil(c * 1e6 - 0.5)).otherwise(F.floor(c * 1e6 + 0.5))  # a long, so no negative 0
    return F.when(F.abs(c) < 1e9, whole.cast("double") / 1e6).otherwise(F.round(c, 6))


def rounded(df, *columns: str):
    from pyspark.sql import functions as F

    return df.withColumns({c: round6(F.col(c)) for c in columns})
