"""Long and wide forms, indicator columns and category codes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.operators.ordered import position
from shelfcast.sources.scratch import stored

MAX_COLUMNS = 10_000


def values_of(df: DataFrame, col: str, limit: int = MAX_COLUMNS) -> list:
    """The sorted distinct values of a small category; more than ``limit`` is an error."""
    rows = df.select(col).filter(F.col(col).isNotNull()).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{col} has more than {limit} values: keep the long form")
    return sorted(r[0] for r in rows)


def to_wide(df: DataFrame, keys: Sequence[str], col: str, val: str, values: Sequence | None = None) -> DataFrame:
    """One column per value of ``col``.  ``val`` must be unique per (keys, col)."""
    return df.groupBy(*keys).pivot(col, list(values or values_of(df, col))).agg(F.first(val))


def to_long(df: DataFrame, ids: Sequence[str], cols: Sequence[str], name: str, value: str) -> DataFrame:
    """One row per column, pairs without a value dropped."""
    return melt(df, ids, cols, name, value).filter(F.col(value).isNotNull())


def melt(df: DataFrame, ids: Sequence[str], cols: Sequence[str], name: str = "Legend", value: str = "value") -> DataFrame:
    """One row per column, nulls kept."""
    return df.unpivot(list(ids), list(cols), name, value)


def get_dummies(df: DataFrame, col: str, values: Sequence | None = None, prefix: str | None = None) -> DataFrame:
    """0/1 columns ``<prefix>_<value>``, one per value."""
    chosen = list(values or values_of(df, col))
    return df.withColumns(
        {f"{prefix or col}_{v}": F.coalesce((F.col(col) == v).cast("double"), F.lit(0.0)) for v in chosen}
    )


def dummies_by(df: DataFrame, key: str, col: str, values: Sequence | None = None, prefix: str | None = None) -> DataFrame:
    """0/1 columns with one row per key: 1 where any row of the key has the value."""
    chosen = list(values or values_of(df, col))
    flags = [F.max((F.col(col) == v).cast("double")).alias(f"{prefix or col}_{v}") for v in chosen]
    return df.groupBy(key).agg(*flags)


def label_codes(df: DataFrame, col: str, out: str, points: Sequence[float] | None = None) -> DataFrame:
    """(value, code) with codes 0.. in sorted order, over distinct values only.

    ``points=[]`` states that the category is short and saves the counting job.
    """
    known = df.select(col).filter(F.col(col).isNotNull()).distinct()
    return position(known, col, name=out, points=points)


def label_encode(df: DataFrame, col: str, out: str | None = None, fitted: DataFrame | None = None) -> DataFrame:
    """Add the sorted-order code of a category.

    Pass ``fitted`` (from ``label_codes``) to give two tables the same codes.
    """
    out = out or f"{col}_code"
    codes = label_codes(df, col, out) if fitted is None else fitted
    return df.join(stored(codes, "codes"), col, "left")


def first_seen_codes(
    df: DataFrame, col: str, order: str, out: str, start: int = 1, points: Sequence[float] | None = None
) -> DataFrame:
    """(value, code), codes counting from ``start`` in the order of first appearance."""
    seen = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.min(order).alias("_first"))
    return position(seen, "_first", name=out, points=points).select(col, (F.col(out) + start).alias(out))


def encode_first_seen(
    df: DataFrame, col: str, order: str, out: str | None = None, start: int = 1, points: Sequence[float] | None = None
) -> DataFrame:
    """Add the first-appearance code of a category."""
    out = out or f"{col}_code"
    return df.join(stored(first_seen_codes(df, col, order, out, start, points), "codes"), col, "left")
