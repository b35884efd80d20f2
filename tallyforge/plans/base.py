"""Registering a query with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, since two engines add in different orders; -0.0 becomes 0.0."""
    kinds = dict(df.dtypes)
    return df.select(*[(F.round(F.col(c), places) + F.lit(0.0)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in df.columns])


def query(name: str, sql: str | None = None, places: int = 6):
    """sql: a SELECT, whose columns named in {…|…} below are rounded alike."""

    def keep(f):
        QUERIES[name] = lambda spark, sf_dir, f=f: rounded(f(spark, sf_dir), places)
        if sql is not None:
            SQL[name] = sql.strip()
        return f

    return keep


def r(*columns: str, places: int = 6) -> str:
    """SQL that rounds columns under their own names."""
    return ", ".join(f"round({c}, {places}) + 0.0 AS {c}" for c in columns)
