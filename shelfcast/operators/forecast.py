"""Forecasting models."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.functions.calendar import weekday, weekend
from shelfcast.functions.scalars import clip_low, null_sentinel
from shelfcast.operators.boosting import Boosted, cross_validate, fit_boosted
from shelfcast.operators.evaluate import holdout_last, rmse
from shelfcast.operators.features import deterministic, feature_names, promo_features
from shelfcast.operators.joins import join_calendar
from shelfcast.operators.regress import fit_ols, fold_models, panel_ols, predict_ols
from shelfcast.operators.reshape import label_codes, label_encode
from shelfcast.operators.resample import resample
from shelfcast.operators.windows import interpolate, lag
from shelfcast.sources.scratch import stored


def daily_oil(oil: DataFrame, col: str = "dcoilwtico") -> DataFrame:
    """A price for every day: gaps filled in, zeros taken as missing, then interpolated to both ends."""
    daily = resample(oil, "D", {col: "sum"}).withColumn(col, null_sentinel(col, 0.0))
    return interpolate(daily, "date", col, both_edges=True)


# Panel: one linear model per series on shared dated features.


def panel_forecast(coefs: DataFrame, future: DataFrame, features: Sequence[str], by: Sequence[str], out: str = "sales") -> DataFrame:
    """Model values for every series and future day.

    The few future days are one short array, spread inside each series' row.
    """
    row = F.struct("date", F.array(*[F.col(f).cast("double") for f in features]).alias("x"))
    days = future.agg(F.collect_list(row)).scalar()
    spread = coefs.select(*by, "coef", F.explode(days).alias("d"))
    dot = F.aggregate(F.zip_with("coef", "d.x", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return spread.select(*by, "d.date", dot.alias(out))


def forecast_to_ids(forecast: DataFrame, test: DataFrame, keys: Sequence[str] = ("store_nbr", "family", "date")) -> DataFrame:
    """(id, sales): the forecast rows with the ids of the test table."""
    return forecast.join(test.select(*keys, "id"), list(keys), "left").select("id", "sales")


# Lag and promotion regression on the deseasonalised series.


def seasonal_residual(series: DataFrame, y: str, by: Sequence[str], fourier: int = 4) -> tuple[DataFrame, list[str]]:
    """Add the dated features, ``seasonal`` (fitted) and ``deseasoned`` (what is left) to each series."""
    by = list(by)
    names = feature_names(fourier=fourier, with_new_year=True)
    shared = deterministic(series, fourier=fourier, with_new_year=True)
    coefs = panel_ols(series, shared, names, y, by)
    rows = join_calendar(series, shared.select("date", *names))
    fitted = predict_ols(rows, coefs, names, by, False, "seasonal")
    return fitted.withColumn("deseasoned", F.col(y) - F.col("seasonal")), names


def lag_promo_model(series: DataFrame, y: str, promo: str, by: Sequence[str], holdout: int = 30) -> DataFrame:
    """Each series on its dated features, its deseasonalised lag and the promotions around the day.

    The last ``holdout`` rows of a series are kept out of the fit.  Values below
    0 are raised to 0 before scoring.
    """
    by = list(by)
    left, names = seasonal_residual(series, y, by)
    lagged = promo_features(lag(left, "date", "deseasoned", 1, by, "y_lag_1"), "date", promo, by)
    around = ["y_lag_1", "promo_lag_1", promo, "promo_lead_1"]
    names = [*names, *around]
    marked = stored(holdout_last(lagged.dropna(how="any", subset=around), "date", holdout, by), "lag-promo")
    coefs = fit_ols(marked.filter(~F.col("is_test")), names, y, by, False)
    out = predict_ols(marked, coefs, names, by, False, "predicted")
    return out.withColumn("predicted", clip_low("predicted")).select(*by, "date", y, "predicted", "is_test")


# Hybrid: linear trend per series, boosted trees on what it leaves.


@dataclass
class Hybrid:
    """A fitted two-stage model."""

    trends: DataFrame
    trees: Boosted
    codes: DataFrame
    by: str
    y: str
    promo: str

    def predict(self, df: DataFrame) -> DataFrame:
        """Needs the time step ``t``, the date and the promotions; adds ``stage_1`` and ``predicted``."""
        rows = _tree_inputs(df, self.codes, self.by, self.promo).join(self.trends, self.by)
        rows = rows.withColumn("stage_1", F.col("slope") * F.col("t") + F.col("intercept"))
        scored = self.trees.transform(rows)
        return scored.withColumn("predicted", clip_low(F.col("stage_1") + F.col("residual"))).drop(
            "slope", "intercept", "_code", "_day", "residual"
        )


def _tree_inputs(df: DataFrame, codes: DataFrame, by: str, promo: str) -> DataFrame:
    return label_encode(df, by, "_code", codes).withColumn("_day", F.dayofmonth("date"))


def hybrid_fit(
    df: DataFrame, by: str = "family", y: str = "sales", promo: str = "onpromotion", rounds: int = 100, depth: int = 6, seed: int = 42
) -> Hybrid:
    """Fit on rows that carry the time step ``t``."""
    t = F.col("t").cast("double")
    # Short tables, stored so that their size is known before the rows would move by a hot key.
    trends = stored(df.groupBy(by).agg(F.regr_slope(y, t).alias("slope"), F.regr_intercept(y, t).alias("intercept")), "trends")
    codes = stored(label_codes(df, by, "_code"), "codes")
    rows = _tree_inputs(df, codes, by, promo).join(trends, by)
    target = rows.withColumn("_rest", F.col(y) - (F.col("slope") * F.col("t") + F.col("intercept")))
    inputs = [promo, "_code", "_day"]
    trees = fit_boosted(stored(target.select(*inputs, "_rest"), "hybrid"), inputs, "_rest", rounds, depth, seed, "residual")
    return Hybrid(trends, trees, codes, by, y, promo)


# Tabular models.

TABULAR = ["id", "family_code", "onpromotion", "day_of_week", "month", "dcoilwtico", "weekend"]


def tabular_frame(fact: DataFrame, oil: DataFrame, codes: DataFrame) -> DataFrame:
    """Numbers only: calendar, price, weekend flag and family code next to id and promotions.

    ``id`` stays among the features.  It grows with the date, so it stands in for
    the time; leave it out of ``features`` for a model without that leak.
    """
    dated = fact.withColumns(
        {
            "day_of_week": weekday("date").cast("bigint"),
            "month": F.month("date").cast("bigint"),
            "weekend": weekend("date").cast("bigint"),
        }
    )
    priced = join_calendar(dated, daily_oil(oil))
    return label_encode(priced, "family", "family_code", codes).drop("date", "store_nbr", "family")


def assemble(df: DataFrame, features: Sequence[str] = TABULAR) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(df)


def tabular_linear(train: DataFrame, features: Sequence[str] = TABULAR, y: str = "sales") -> LinearRegressionModel:
    """Normal equations, so no iterations.  Pass a stored table: a fit reads it more than once."""
    return LinearRegression(labelCol=y, predictionCol="predicted", solver="normal").fit(assemble(train, features))


def tabular_boosted(
    train: DataFrame, features: Sequence[str] = TABULAR, y: str = "sales", rounds: int = 300, depth: int = 9, seed: int = 42
) -> Boosted:
    """Boosted trees.  Pass a stored table: the fit reads it more than once."""
    return fit_boosted(train, features, y, rounds, depth, seed)


def cv_boosted(
    df: DataFrame, k: int = 10, features: Sequence[str] = TABULAR, y: str = "sales", rounds: int = 100, depth: int = 6, seed: int = 42
) -> DataFrame:
    """(fold, rmse, n) of boosted trees; needs a ``fold`` column.  Each fold is one distributed fit."""
    rows = stored(df.select("fold", *features, y), "folds")
    return cross_validate(rows, features, y, "fold", k, rounds, depth, seed)


def cv_linear(df: DataFrame, k: int = 10, features: Sequence[str] = TABULAR, y: str = "sales") -> DataFrame:
    """(fold, rmse, n) of the linear model: one pass for all fits, one for all scores."""
    models = fold_models(df, features, y, "fold", k).select("fold", "coef")
    scored = predict_ols(df, models, features, ["fold"], True, "predicted")
    return scored.groupBy("fold").agg(rmse(y, "predicted").alias("rmse"), F.count(F.lit(1)).alias("n"))
