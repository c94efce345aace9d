"""The registry that every module of queries adds to."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .inputs import SQL

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
#: Iterations a phase of the registered chains; the operators' default is 50,000.
ITERATIONS = 1000


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir), and SQL that continues the common inputs' WITH list."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = SQL + sql
        return f

    return register


def rounded(column: str, digits: int = 6, name: str | None = None) -> Column:
    return F.round(column, digits).alias(name or column)
