"""Dated features: trend, weekly indicators, monthly waves, holidays, promotions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.functions.calendar import new_year
from shelfcast.operators.ordered import position
from shelfcast.operators.reshape import dummies_by
from shelfcast.operators.windows import lag, lead


def feature_names(constant=True, order=1, seasonal=True, fourier=4, with_new_year=False) -> list[str]:
    names = ["const"] if constant else []
    names += ["trend" if p == 1 else f"trend_{p}" for p in range(1, order + 1)]
    names += [f"s_{k}" for k in range(2 if constant else 1, 8)] if seasonal else []
    names += [f"{f}_{k}" for k in range(1, fourier + 1) for f in ("sin", "cos")]
    return names + (["new_year"] if with_new_year else [])


def fourier_columns(date: str, order: int) -> dict[str, Column]:
    """Sine and cosine pairs over the calendar month; the phase is (day - 1) / days in the month."""
    phase = (F.dayofmonth(date) - 1) / F.dayofmonth(F.last_day(date))
    out = {}
    for k in range(1, order + 1):
        angle = phase * (2 * math.pi * k)
        out[f"sin_{k}"], out[f"cos_{k}"] = F.sin(angle), F.cos(angle)
    return out


def add_fourier(df: DataFrame, date: str = "date", order: int = 4) -> DataFrame:
    return df.withColumns(fourier_columns(date, order))


def deterministic(
    spine: DataFrame,
    date: str = "date",
    constant: bool = True,
    order: int = 1,
    seasonal: bool = True,
    fourier: int = 4,
    with_new_year: bool = False,
    steps: int = 0,
) -> DataFrame:
    """Features for the distinct dates of ``spine`` and the ``steps`` days after the last one.

    ``t`` counts the dates from 1 and runs on into the future rows, which
    ``future`` marks.  The weekly indicators follow t, not the calendar weekday;
    the first is left out beside a constant.
    """
    dates = position(spine.select(date).filter(F.col(date).isNotNull()).distinct(), date, name="_p", points=[])
    rows = dates.select(date, (F.col("_p") + 1).alias("t"), F.lit(False).alias("future"))
    if steps:
        is_last = F.lead(date).over(Window.orderBy(date)).isNull()
        ahead = F.when(F.col("_last"), F.sequence(F.lit(0), F.lit(steps))).otherwise(F.array(F.lit(0)))
        rows = rows.withColumn("_last", is_last).withColumn("_k", F.explode(ahead)).select(
            F.date_add(date, F.col("_k")).alias(date), (F.col("t") + F.col("_k")).alias("t"), (F.col("_k") > 0).alias("future")
        )
    t = F.col("t").cast("double")
    cols: dict[str, Column] = {"const": F.lit(1.0)} if constant else {}
    for p in range(1, order + 1):
        cols["trend" if p == 1 else f"trend_{p}"] = F.pow(t, F.lit(float(p))) if p > 1 else t
    if seasonal:
        for k in range(2 if constant else 1, 8):
            cols[f"s_{k}"] = (F.pmod(F.col("t") - 1, F.lit(7)) == k - 1).cast("double")
    cols |= fourier_columns(date, fourier)
    if with_new_year:
        cols["new_year"] = new_year(date).cast("double")
    return rows.withColumns(cols)


def holiday_indicators(
    holidays: DataFrame, locales: Sequence[str], lo: str, hi: str, values: Sequence[str], prefix: str = "hol"
) -> DataFrame:
    """0/1 columns per holiday name, one row per date."""
    chosen = holidays.filter(
        F.col("locale").isin(*locales) & F.col("date").between(F.lit(lo).cast("date"), F.lit(hi).cast("date"))
    )
    return dummies_by(chosen, "date", "description", values, prefix)


def promo_features(df: DataFrame, order: str = "date", promo: str = "onpromotion", by: Sequence[str] = ()) -> DataFrame:
    """The day before, the day itself and the day after."""
    return lead(lag(df, order, promo, 1, by, "promo_lag_1"), order, promo, 1, by, "promo_lead_1")
