"""Joins.

No side is broadcast by hand.  The planner broadcasts a side whose measured size
is under ``spark.sql.autoBroadcastJoinThreshold`` and otherwise shuffles both;
adaptive execution then splits partitions that one hot key has made too large.
Dated tables, short as a rule, are stored first, so that their size is measured
before the facts would move.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.sources.scratch import stored


def merge(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str],
    how: str = "inner",
    suffixes: tuple[str, str] = ("_x", "_y"),
    null_safe: bool = False,
) -> DataFrame:
    """Equi-join on shared names; other shared names get the two suffixes.

    ``null_safe`` lets a missing key meet a missing key.
    """
    keys = [on] if isinstance(on, str) else list(on)
    clash = (set(left.columns) & set(right.columns)) - set(keys)
    left = left.withColumnsRenamed({c: c + suffixes[0] for c in clash})
    right = right.withColumnsRenamed({c: c + suffixes[1] for c in clash})
    if not null_safe:
        return left.join(right, keys, how)
    right = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    match: Column = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    joined = left.join(right, match, how)
    key_cols = [F.coalesce(k, f"_r_{k}").alias(k) for k in keys]
    rest = [c for c in joined.columns if c not in keys and c not in {f"_r_{k}" for k in keys}]
    return joined.select(*key_cols, *rest)


def salted_join(
    left: DataFrame, right: DataFrame, on: str | Sequence[str], salt_by: str, how: str = "inner", salts: int = 16
) -> DataFrame:
    """Inner or left join whose hot keys are spread over ``salts`` tasks each.

    For sessions without adaptive execution, or for keys hotter than it can
    split.  The right side is repeated ``salts`` times, so it should be the short
    one.  The salt of a left row is a hash of its ``salt_by`` column, so a retried
    task gives it the same one.
    """
    if how not in ("inner", "left"):
        raise ValueError("only inner and left joins can repeat their right side")
    keys = [on] if isinstance(on, str) else list(on)
    left = left.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int"))
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def natural_join(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    """Join on every name the two sides share."""
    keys = [c for c in left.columns if c in right.columns]
    if not keys:
        raise ValueError("no shared column to join on")
    return left.join(right, keys, how)


def sales_on_dates(fact: DataFrame, dates: DataFrame, date: str = "date") -> DataFrame:
    """The rows whose date is in the list."""
    return fact.join(stored(dates.select(date).distinct(), "dates"), date, "left_semi")


def join_calendar(fact: DataFrame, daily: DataFrame, how: str = "inner", on: str = "date") -> DataFrame:
    """Join a table of a few rows per day (prices, holidays), broadcast if it is small by measure."""
    return merge(fact, stored(daily, "daily"), on, how)


def fill_after_join(left: DataFrame, indicators: DataFrame, on: str = "date") -> DataFrame:
    """Left join of indicator columns, absent ones 0."""
    cols = [c for c in indicators.columns if c != on]
    return left.join(stored(indicators, "indicators"), on, "left").na.fill(0.0, cols)


def align(left: DataFrame, right: DataFrame, on: str | Sequence[str] = "date") -> DataFrame:
    """Keep the keys both sides have."""
    return left.join(right, [on] if isinstance(on, str) else list(on), "inner")


def concat_by_key(frames: Sequence[DataFrame], on: str | Sequence[str] = "date") -> DataFrame:
    """Columns side by side on a key, absent ones null."""
    keys = [on] if isinstance(on, str) else list(on)
    out = frames[0]
    for other in frames[1:]:
        out = out.join(other, keys, "full")
    return out


def star_left(fact, holidays, oil, stores, transactions) -> DataFrame:
    """Every sale with what is known of its day and store.  Two holiday rows on a date double its sales rows."""
    out = join_calendar(fact, holidays, "left")
    out = join_calendar(out, oil, "left")
    out = merge(out, stores, "store_nbr", "left")
    return merge(out, transactions, ["date", "store_nbr"], "left")


def star_inner(fact, holidays, stores, transactions) -> DataFrame:
    """Sales on holidays, in known stores, on days with transactions."""
    out = join_calendar(fact, holidays)
    out = merge(out, stores, "store_nbr")
    return merge(out, transactions, ["date", "store_nbr"])
