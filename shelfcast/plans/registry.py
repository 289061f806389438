"""The list of queries and the SQL each is checked against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.sources.roles import with_roles

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` may name the roles as if they were tables and use ``exact_mean(x)``."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = _EXACT_MEAN.sub(_exact_mean_sql, with_roles(sql))
        return fn

    return add


# The argument may hold parentheses, one level deep.
_EXACT_MEAN = re.compile(r"exact_mean\(((?:[^()]|\([^()]*\))*)\)")


def _exact_mean_sql(found: re.Match) -> str:
    """Half up in integers: what ``exact_mean`` gives for amounts that are not negative."""
    total, n = f"sum(CAST(round(({found[1]}) * 100) AS BIGINT))", f"count({found[1]})"
    return f"(CAST((20000 * {total} + {n}) // (2 * {n}) AS DOUBLE) / 1e6)"


def exact(df: DataFrame, *cols: str) -> DataFrame:
    """Amounts of two places as decimals: their sums do not depend on order, their means are exact to six places."""
    return df.withColumns({c: F.col(c).cast("decimal(18,2)") for c in cols})


def doubles(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in cols})


def exact_mean(col: str) -> Column:
    """Mean of amounts of two places, rounded half up to six places without going through doubles."""
    return F.avg(F.col(col).cast("decimal(18,2)")).cast("double")


def spine_sql(rel: str, keys: str = "") -> str:
    """Every day between the first and last date of a relation, per key."""
    days = "CAST(unnest(generate_series(CAST(min(date) AS TIMESTAMP), CAST(max(date) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date"
    return f"(SELECT {keys + ', ' if keys else ''}{days} FROM {rel}{' GROUP BY ' + keys if keys else ''})"


def round_all(df: DataFrame, places: int, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), places) for c in cols})
