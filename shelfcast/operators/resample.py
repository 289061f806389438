"""Calendar buckets with empty ones filled in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Bucket start, step and label (weeks are named by their Sunday, months by their last day).
_BUCKETS = {
    "D": (lambda d: F.col(d), "INTERVAL 1 DAY", lambda s: s),
    "W": (lambda d: F.date_trunc("week", d).cast("date"), "INTERVAL 7 DAY", lambda s: F.date_add(s, 6)),
    "M": (lambda d: F.trunc(d, "month"), "INTERVAL 1 MONTH", lambda s: F.last_day(s)),
}


def bucket_label(date: str, freq: str) -> Column:
    start, _, label = _BUCKETS[freq]
    return label(start(date))


def resample(
    df: DataFrame, freq: str, aggs: dict[str, str], date: str = "date", by: Sequence[str] = ()
) -> DataFrame:
    """Sum or mean per day ('D'), week ('W') or month ('M'), with no bucket left out.

    Each key is filled between its own first and last bucket.  An empty bucket
    sums to 0 and has no mean.  Rows are aggregated first; the gap filling then
    looks at one row per bucket and key, a number bounded by the calendar, so a
    hot key costs no more than any other.
    """
    by = list(by)
    start, step, label = _BUCKETS[freq]
    named = {"sum": lambda c: F.coalesce(F.sum(c), F.lit(0)), "mean": F.avg}
    kept = df.filter(F.col(date).isNotNull())
    for k in by:
        kept = kept.filter(F.col(k).isNotNull())
    full = kept.groupBy(*by, start(date).cast("date").alias("_s")).agg(*[named[f](c).alias(c) for c, f in aggs.items()])
    every = F.expr(step)
    until = F.coalesce(F.lead("_s").over(Window.partitionBy(*by).orderBy("_s")) - every, F.col("_s")).cast("date")
    runs = full.withColumn("_until", until).withColumn("_day", F.explode(F.sequence("_s", "_until", every)))
    own = F.col("_day") == F.col("_s")
    empty = {"sum": F.lit(0), "mean": F.lit(None)}
    return runs.select(
        *by,
        label(F.col("_day")).alias(date),
        *[F.when(own, F.col(c)).otherwise(empty[f]).alias(c) for c, f in aggs.items()],
    )


def grouped(df: DataFrame, key: str, freq: str, col: str) -> DataFrame:
    """Mean of a column per calendar bucket of ``key``, gaps kept as nulls."""
    return resample(df.select(key, col), freq, {col: "mean"}, key)


def overlay_by_year(df: DataFrame, col: str, date: str = "date") -> DataFrame:
    """Monthly means with year and month name beside them, to lay years over each other."""
    monthly = resample(df, "M", {col: "mean"}, date)
    return monthly.withColumns(
        {
            "year": F.year(date).cast("bigint"),
            "month_nbr": F.month(date).cast("bigint"),
            "month": F.date_format(date, "MMMM"),
        }
    )


def weekday_profile(df: DataFrame, col: str, date: str = "date") -> DataFrame:
    """Mean per (year, weekday), Monday 1."""
    return df.groupBy(
        F.year(date).cast("bigint").alias("year"), (F.weekday(date) + 1).cast("bigint").alias("dayofweek")
    ).agg(F.avg(col).alias(col))


def seasonal(df: DataFrame, col: str, period: Column, freq: Column) -> DataFrame:
    """Mean of a column per (period, step within the period), e.g. (week, weekday)."""
    return df.groupBy(period.alias("period"), freq.alias("freq")).agg(F.avg(col).alias(col))
