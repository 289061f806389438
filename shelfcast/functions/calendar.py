"""Calendar columns and the date spine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Display order of weekdays and months.
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
MONTHS = [
    "January",
    "February",
    "March",
    "April",
    "May",
    "June",
    "July",
    "August",
    "September",
    "October",
    "November",
    "December",
]


def weekday(date) -> Column:
    """Monday 0 .. Sunday 6."""
    return F.weekday(date)


def weekday_name(date) -> Column:
    return F.date_format(date, "EEEE")


def month_name(date) -> Column:
    return F.date_format(date, "MMMM")


def weekend(date) -> Column:
    """1 on Saturday and Sunday, else 0."""
    return weekday(date).isin(5, 6).cast("int")


def new_year(date) -> Column:
    return F.dayofyear(date) == 1


def date_spine(spark: SparkSession, lo, hi) -> DataFrame:
    """One row per day from ``lo`` to ``hi``, both included; bounds are dates or ISO text."""
    days = F.sequence(F.lit(lo).cast("date"), F.lit(hi).cast("date"))
    return spark.range(1).select(F.explode(days).alias("date"))


def in_year(date, year: int) -> Column:
    """The year as a closed date range, which a scan can push down and a partition filter can prune on."""
    return F.col(date).between(F.lit(f"{year}-01-01").cast("date"), F.lit(f"{year}-12-31").cast("date"))


def add_calendar(df: DataFrame, date: str = "date") -> DataFrame:
    """Weekday number and name, month and year as columns, in one projection."""
    return df.withColumns(
        {
            "day_of_week": weekday(date).cast("bigint"),
            "day_name": weekday_name(date),
            "month": F.month(date).cast("bigint"),
            "year": F.year(date).cast("bigint"),
        }
    )


def order_by_name(col, names: list[str]) -> Column:
    """Sort key that puts names into the given order."""
    return F.array_position(F.lit(names), F.col(col))
