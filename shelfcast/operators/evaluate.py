"""Splits and scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.operators.ordered import running_totals


def rmse(y: str, p: str) -> Column:
    d = F.col(y) - F.col(p)
    return F.sqrt(F.avg(d * d))


def rmsle(y: str, p: str) -> Column:
    """Root mean squared log error; a negative value is an error, so clip first."""

    def log1(c):
        return F.when(F.col(c) < 0, F.raise_error(F.lit("negative value: clip at 0 first"))).otherwise(F.log1p(c))

    d = log1(y) - log1(p)
    return F.sqrt(F.avg(d * d))


def r2(y: str, p: str) -> Column:
    """1 - residual / total sum of squares, in one pass."""
    d = F.col(y) - F.col(p)
    return 1 - F.sum(d * d) / F.nullif(F.var_pop(y) * F.count(y), F.lit(0.0))


def scores(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(rmse(y, p).alias("rmse"), r2(y, p).alias("r2"), F.count(F.lit(1)).alias("n"))


def mean_over_folds(folds: DataFrame, score: str = "rmse") -> DataFrame:
    """One row: the mean of a score over the folds, each counting once, and their number."""
    return folds.agg(F.avg(score).alias(score), F.count(score).alias("folds"))


def holdout_last(df: DataFrame, order: str, n: int, by: Sequence[str] = (), points=None) -> DataFrame:
    """Mark the last ``n`` rows of each key with ``is_test``."""
    counted = running_totals(df, order, {"_t": F.lit(1).cast("bigint")}, by, points)
    return counted.withColumn("is_test", F.col("_t") >= F.col("_t_all") - n).drop("_t", "_t_all")


def holdout_from(df: DataFrame, date: str, first: str) -> DataFrame:
    """Mark the rows from a date on."""
    return df.withColumn("is_test", F.col(date) >= F.lit(first).cast("date"))


def assign_folds(
    df: DataFrame, order: str, k: int, out: str = "fold", points=None, then: Sequence[str] = ()
) -> DataFrame:
    """k runs of consecutive rows, 0..k-1, the first n mod k of them one row longer."""
    placed = running_totals(df, order, {"_t": F.lit(1).cast("bigint")}, (), points, then)
    t, n = F.col("_t"), F.col("_t_all")
    small = F.floor(n / k)
    long_rows = (n % k) * (small + 1)
    fold = F.when(t < long_rows, F.floor(t / (small + 1))).otherwise(
        n % k + F.floor((t - long_rows) / F.nullif(small, F.lit(0)))
    )
    return placed.withColumn(out, fold.cast("int")).drop("_t", "_t_all")
