"""Conditional columns and arithmetic helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

PRIME = 2_147_483_647  # 2^31 - 1


def null_sentinel(col, sentinel=0) -> Column:
    """The value that stands for missing becomes NULL."""
    return F.nullif(F.col(col), F.lit(sentinel))


def clip_low(col, low: float = 0.0) -> Column:
    """Lower bound that leaves NULL alone."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c.isNotNull(), F.greatest(c, F.lit(low)))


def recode(df: DataFrame, col: str, codes: dict, out: str | None = None) -> DataFrame:
    """Replace values by a small dictionary; values it does not name become NULL."""
    pairs = [F.lit(x) for item in codes.items() for x in item]
    return df.withColumn(out or col, F.try_element_at(F.create_map(*pairs), F.col(col)))


def select_numeric(df: DataFrame) -> DataFrame:
    return df.select([f.name for f in df.schema if isinstance(f.dataType, NumericType)])


def mixed_key(key, seed: int) -> Column:
    """A scrambled number in [0, 2^31-1) from an integer key.

    Plain integer arithmetic: the same on every layout, retry and engine.
    """
    k = F.abs(F.col(key).cast("bigint"))
    low = k % PRIME
    high = ((k - low) / PRIME).cast("bigint") % PRIME
    start = (low + high * 31 + seed) % PRIME
    once = (start * start + seed) % PRIME
    twice = (once * once + start) % PRIME
    return (twice * twice + once) % PRIME


def split_random(df: DataFrame, key: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Mark rows for test by their key; a retried task marks the same rows again."""
    return df.withColumn("is_test", mixed_key(key, seed) % 10_000 < int(round(test_share * 10_000)))
