"""Exact quantiles of columns of any length.

The built-in exact percentile keeps every distinct value of a group in one
buffer.  Here values are counted, the counts summed along the value order in
blocks, and the two values around each wanted rank picked out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.operators.ordered import running_totals


def quantiles(
    df: DataFrame,
    col: str,
    probs: dict[str, float],
    by: Sequence[str] = (),
    points: Sequence[float] | None = None,
) -> DataFrame:
    """One row per key: each named quantile, interpolated linearly between ranks."""
    by = list(by)
    value = F.col(col).cast("double").alias("_v")
    counts = df.select(*by, value).filter("_v IS NOT NULL AND NOT isnan(_v)").groupBy(*by, "_v").agg(
        F.count(F.lit(1)).alias("_n")
    )
    ranked = running_totals(counts, "_v", {"_b": F.col("_n")}, by, points)

    def at(rank):
        return F.max(F.when((F.col("_b") <= rank) & (rank < F.col("_b") + F.col("_n")), F.col("_v")))

    aggs, exprs = [], []
    for name, p in probs.items():
        want = (F.col("_b_all") - 1) * F.lit(float(p))
        aggs += [
            at(F.floor(want)).alias(f"_lo_{name}"),
            at(F.ceil(want)).alias(f"_hi_{name}"),
            F.max(want - F.floor(want)).alias(f"_f_{name}"),
        ]
        lo, hi, f = (F.col(f"_{k}_{name}") for k in ("lo", "hi", "f"))
        exprs.append((lo + (hi - lo) * f).alias(name))
    return ranked.groupBy(*by).agg(*aggs).select(*by, *exprs)


def median(df: DataFrame, col: str, by: Sequence[str] = (), out: str = "median") -> DataFrame:
    return quantiles(df, col, {out: 0.5}, by)


def mode(df: DataFrame, col: str, out: str = "mode", by: Sequence[str] = ()) -> DataFrame:
    """The most frequent value, the smallest of them on a tie."""
    by = list(by)
    counts = df.filter(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count(F.lit(1)).alias("_n"))
    best = F.min(F.struct((-F.col("_n")).alias("n"), F.col(col).alias("v")))
    return counts.groupBy(*by).agg(best["v"].alias(out))
