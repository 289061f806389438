"""Moving averages, lags, leads, interpolation and serial correlation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.operators.ordered import join_keys, neighbours, over_rows, position
from shelfcast.sources.scratch import stored


def moving_avg(
    df: DataFrame,
    order: str,
    val: str,
    window: int,
    min_periods: int | None = None,
    by: Sequence[str] = (),
    out: str | None = None,
    points: Sequence[float] | None = None,
) -> DataFrame:
    """Centred moving average; an even window takes one row more before than after."""
    before, after = window // 2, (window - 1) // 2
    need = window if min_periods is None else min_periods

    def columns(spec) -> dict[str, Column]:
        frame = spec.rowsBetween(-before, after)
        return {out or f"{val}_ma": F.when(F.count(val).over(frame) >= need, F.avg(val).over(frame))}

    return over_rows(df, order, columns, before, by, points)


def _shifted(df, order, col, steps, by, names, points, back: bool) -> DataFrame:
    shift = F.lag if back else F.lead

    def columns(spec) -> dict[str, Column]:
        return {name: shift(col, k).over(spec) for k, name in zip(steps, names)}

    return over_rows(df, order, columns, max(steps, default=0), by, points)


def lag(df: DataFrame, order: str, col: str, k: int = 1, by: Sequence[str] = (), out=None, points=None) -> DataFrame:
    return _shifted(df, order, col, [k], by, [out or f"{col}_lag_{k}"], points, True)


def lead(df: DataFrame, order: str, col: str, k: int = 1, by: Sequence[str] = (), out=None, points=None) -> DataFrame:
    return _shifted(df, order, col, [k], by, [out or f"{col}_lead_{k}"], points, False)


def make_lags(
    df: DataFrame, order: str, col: str, lags: int, by: Sequence[str] = (), name: str = "y", points=None
) -> DataFrame:
    """Columns ``<name>_lag_1`` .. ``<name>_lag_n``, all over one window."""
    steps = range(1, lags + 1)
    return _shifted(df, order, col, steps, by, [f"{name}_lag_{k}" for k in steps], points, True)


def make_leads(
    df: DataFrame, order: str, col: str, leads: int, by: Sequence[str] = (), name: str = "y", points=None
) -> DataFrame:
    steps = range(1, leads + 1)
    return _shifted(df, order, col, steps, by, [f"{name}_lead_{k}" for k in steps], points, False)


def time_step(df: DataFrame, order: str, by: Sequence[str] = (), out: str = "time", points=None) -> DataFrame:
    """Counts rows from 0 along the order."""
    return position(df, order, by, out, points)


def interpolate(
    df: DataFrame,
    order: str,
    val: str,
    by: Sequence[str] = (),
    both_edges: bool = False,
    out: str | None = None,
    points: Sequence[float] | None = None,
) -> DataFrame:
    """Linear interpolation by row position.

    Missing values after the last known one take it.  Those before the first
    known one stay missing, or take it when ``both_edges`` is set.
    """
    found = neighbours(df, order, val, by, points)
    prev, nxt, t = F.col("_prev"), F.col("_next"), F.col("_t")
    share = (t - prev["t"]) / (nxt["t"] - prev["t"])
    inner = prev["v"] + (nxt["v"] - prev["v"]) * share
    edge = nxt["v"] if both_edges else F.lit(None).cast("double")
    filled = (
        F.when(F.col(val).isNotNull(), F.col(val))
        .when(prev.isNotNull() & nxt.isNotNull(), inner)
        .when(prev.isNotNull(), prev["v"])
        .otherwise(edge)
    )
    return found.withColumn(out or val, filled).drop("_t", "_prev", "_next")


def zscore(df: DataFrame, val: str, by: Sequence[str] = (), out: str | None = None) -> DataFrame:
    """Distance from the mean in sample deviations.

    The two moments come from a partial aggregate and are joined back, so a key
    with many rows is never gathered in one window.
    """
    by = list(by)
    moments = [F.avg(val).alias("_m"), F.stddev_samp(val).alias("_s")]
    score = (F.col(val) - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0))
    if by:
        joined = join_keys(df, stored(df.groupBy(*by).agg(*moments), "moments"), by)
    else:
        joined = df.withColumn("_z", df.agg(F.struct(*moments).alias("z")).scalar()).select("*", "_z.*").drop("_z")
    return joined.withColumn(out or f"{val}_z", score).drop("_m", "_s")


def _shift_corr(df, order, x, y, steps, by, points, back: bool) -> DataFrame:
    by, name = list(by), "lag" if back else "lead"
    cols = [f"_{name}_{k}" for k in steps]
    shifted = _shifted(df, order, x, steps, by, cols, points, back)
    wide = shifted.groupBy(*by).agg(*[F.corr(y or x, c).alias(c) for c in cols])
    pairs = F.array(*[F.struct(F.lit(k).cast("bigint").alias(name), F.col(c).alias("corr")) for k, c in zip(steps, cols)])
    return wide.select(*by, F.explode(pairs).alias("p")).select(*by, f"p.{name}", "p.corr")


def lag_corr(
    df: DataFrame, order: str, x: str, y: str | None = None, lags: int = 8, by: Sequence[str] = (), points=None
) -> DataFrame:
    """Correlation of ``y`` (``x`` itself by default) with ``x`` shifted back by 1..n rows.

    Centring and scaling either series would not change it.
    """
    return _shift_corr(df, order, x, y, range(1, lags + 1), by, points, True)


def lead_corr(
    df: DataFrame, order: str, x: str, y: str | None = None, leads: int = 8, by: Sequence[str] = (), points=None
) -> DataFrame:
    """As ``lag_corr`` with ``x`` shifted ahead."""
    return _shift_corr(df, order, x, y, range(1, leads + 1), by, points, False)
