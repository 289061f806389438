"""Least squares from distributed sums of products."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from shelfcast.operators.ordered import join_keys
from shelfcast.sources.scratch import stored


def _inputs(features: Sequence[str], intercept: bool) -> list[Column]:
    """The model's inputs as columns ``_x0`` .. in order."""
    ones = [F.lit(1.0)] if intercept else []
    xs = ones + [F.col(f).cast("double") for f in features]
    return [x.alias(f"_x{i}") for i, x in enumerate(xs)]


def _gram(size: int) -> Column:
    """Upper triangle of X'X, row by row.  One text, since hundreds of column calls are slow to build."""
    return F.expr("array(" + ", ".join(f"sum(_x{i} * _x{j})" for i in range(size) for j in range(i, size)) + ")")


def _cross(size: int) -> Column:
    """X'y."""
    return F.expr("array(" + ", ".join(f"sum(_x{i} * _y)" for i in range(size)) + ")")


def _known(size: int) -> Column:
    """Every input present, as one test per column.

    A single test over all columns (as ``dropna`` makes) would let the optimizer
    derive a variant of it for every subset of renamed columns.
    """
    return F.expr(" AND ".join(["_y IS NOT NULL", *[f"_x{i} IS NOT NULL" for i in range(size)]]))


def _square(flat: np.ndarray, size: int) -> np.ndarray:
    """Symmetric matrices from their upper triangles, one per row of ``flat``."""
    out = np.zeros((len(flat), size, size))
    upper = np.triu_indices(size)
    out[:, upper[0], upper[1]] = flat
    out[:, upper[1], upper[0]] = flat
    return out


def _solve(gram: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Batched normal equations, scaled to a unit diagonal; directions without data get weight 0."""
    size = np.sqrt(np.einsum("nii->ni", gram))
    scale = np.where(size > 0, size, 1.0)
    inverse = np.linalg.pinv(gram / (scale[:, :, None] * scale[:, None, :]), rcond=1e-11, hermitian=True)
    return np.einsum("nij,nj->ni", inverse, right / scale) / scale


def _solver(size: int):
    """Moment rows in, coefficient rows out; one short row per model."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                gram = _square(np.stack(pdf["_gram"].to_numpy()), size)
                coef = _solve(gram, np.stack(pdf["_xy"].to_numpy()))
                pdf = pdf.drop(columns=["_gram", "_xy"]).assign(coef=list(coef))
            else:
                pdf = pdf.drop(columns=["_gram", "_xy"]).assign(coef=[])
            yield pdf

    return run


def _coefficients(moments: DataFrame, size: int) -> DataFrame:
    kept = [f for f in moments.schema.fields if f.name not in ("_gram", "_xy")]
    schema = StructType([*kept, StructField("coef", ArrayType(DoubleType()))])
    return moments.mapInPandas(_solver(size), schema)


def fit_ols(
    df: DataFrame, features: Sequence[str], y: str, by: Sequence[str] = (), intercept: bool = True
) -> DataFrame:
    """One row per key: ``n`` and ``coef`` (intercept first, if there is one).

    The table is read once.  Each task adds up its products, so only one short
    row of sums per task and key is shuffled, whatever the size of a key.
    """
    by, xs = list(by), _inputs(features, intercept)
    clean = df.select(*by, *xs, F.col(y).cast("double").alias("_y"))
    moments = clean.filter(_known(len(xs))).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), _gram(len(xs)).alias("_gram"), _cross(len(xs)).alias("_xy")
    )
    return _coefficients(moments.filter("n > 0"), len(xs))


def predict_ols(
    df: DataFrame,
    coefs: DataFrame,
    features: Sequence[str],
    by: Sequence[str] = (),
    intercept: bool = True,
    out: str = "fitted",
) -> DataFrame:
    """Add the model value.  A single model is read as a subquery, many are joined on their key."""
    by = list(by)
    if by:
        rows = join_keys(df, stored(coefs.select(*by, F.col("coef").alias("_coef")), "coefficients"), by)
    else:
        rows = df.withColumn("_coef", coefs.select("coef").scalar())
    first = int(intercept)
    terms = ["_coef[0]"] if intercept else []
    terms += [f"_coef[{i}] * cast(`{f}` as double)" for i, f in enumerate(features, first)]
    return rows.withColumn(out, F.expr(" + ".join(terms))).drop("_coef")


def ols(df: DataFrame, features: Sequence[str], y: str, by: Sequence[str] = (), intercept: bool = True, out: str = "fitted") -> DataFrame:
    """Fit and add the fitted values."""
    return predict_ols(df, fit_ols(df, features, y, by, intercept), features, by, intercept, out)


def coefficient_rows(coefs: DataFrame, features: Sequence[str], by: Sequence[str] = (), intercept: bool = True) -> DataFrame:
    """Long form: (key, feature, coef)."""
    names = (["intercept"] if intercept else []) + list(features)
    pairs = F.arrays_zip(F.lit(names).alias("feature"), F.col("coef").alias("coef"))
    return coefs.select(*by, F.explode(pairs).alias("p")).select(*by, "p.feature", "p.coef")


def panel_ols(
    long: DataFrame, shared: DataFrame, features: Sequence[str], y: str, by: Sequence[str], date: str = "date"
) -> DataFrame:
    """One least-squares model per series, all on the same dated features.

    X'X is the same for every series and is taken from the feature table, which is
    stored: read twice, and broadcast if it is small by measure.  The facts give one sum per feature and series; a
    day without a row counts as 0, so gaps need not be filled.
    """
    by, xs = list(by), _inputs(features, False)
    dated = stored(shared.select(date, *xs), "dated")
    sums = (
        long.select(*by, date, F.col(y).cast("double").alias("_y"))
        .join(dated, date)
        .groupBy(*by)
        .agg(F.count(F.lit(1)).alias("n"), _cross(len(xs)).alias("_xy"))
    )
    return _coefficients(sums.withColumn("_gram", dated.agg(_gram(len(xs))).scalar()), len(xs))


def fold_models(df: DataFrame, features: Sequence[str], y: str, fold: str, k: int) -> DataFrame:
    """For each fold the coefficients of the model trained on all the others.

    The sums of the training rows are the sums of all rows less the fold's own,
    so k models need one pass.
    """
    xs = _inputs(features, True)
    size = len(xs)
    clean = df.select(fold, *xs, F.col(y).cast("double").alias("_y"))
    own = clean.filter(_known(size)).groupBy(fold).agg(
        F.count(F.lit(1)).alias("n"), _gram(size).alias("_gram"), _cross(size).alias("_xy")
    )

    def total(name, width):
        return F.expr("array(" + ", ".join(f"sum({name}[{i}])" for i in range(width)) + ")")

    whole = own.agg(
        F.struct(
            F.sum("n").alias("n"), total("_gram", size * (size + 1) // 2).alias("g"), total("_xy", size).alias("b")
        ).alias("w")
    )
    rest = own.withColumn("w", whole.scalar()).select(
        fold,
        (F.col("w.n") - F.col("n")).alias("n"),
        F.zip_with("w.g", "_gram", lambda a, b: a - b).alias("_gram"),
        F.zip_with("w.b", "_xy", lambda a, b: a - b).alias("_xy"),
    )
    return _coefficients(rest, size)
