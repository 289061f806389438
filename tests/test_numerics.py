"""Numbers against NumPy and plain loops."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfcast.operators import features as X
from shelfcast.operators import forecast as M
from shelfcast.operators import regress as R
from shelfcast.operators import stats as S
from shelfcast.operators import windows as W
from shelfcast.operators.evaluate import assign_folds, rmse
from shelfcast.operators.smooth import lowess
from shelfcast.operators.spectrum import squared_spectrum

RNG = np.random.default_rng(5)


@pytest.fixture(scope="module")
def panel(spark):
    """Three series of 120 days, one of them with days missing."""
    days = pd.date_range("2000-01-01", periods=120)
    parts = [
        pd.DataFrame({"k": k, "date": days.date, "y": 50 + i * 10 + 0.3 * np.arange(120) + RNG.normal(size=120) * 5, "p": RNG.integers(0, 9, 120)})
        for i, k in enumerate("abc")
    ]
    parts[2] = parts[2].drop(index=[5, 40, 41, 77])
    pdf = pd.concat(parts, ignore_index=True)
    return pdf, spark.createDataFrame(pdf, "k string, date date, y double, p long").repartition(3).cache()


def design(n, days):
    t = np.arange(1, n + 1)
    dates = pd.DatetimeIndex(pd.to_datetime(days))
    phase = ((dates.day - 1) / dates.days_in_month).to_numpy()
    cols = [np.ones(n), t] + [((t - 1) % 7 == k).astype(float) for k in range(1, 7)]
    for k in range(1, 5):
        cols += [np.sin(2 * np.pi * k * phase), np.cos(2 * np.pi * k * phase)]
    return np.stack(cols, axis=1)


def test_features_equal_numpy(panel):
    pdf, df = panel
    out = X.deterministic(df, steps=10).orderBy("date").toPandas()
    days = pd.date_range("2000-01-01", periods=130)
    assert out[X.feature_names()].to_numpy() == pytest.approx(design(130, days))
    assert out.future.tolist() == [False] * 120 + [True] * 10


def test_panel_model_and_forecast(panel):
    pdf, df = panel
    names = X.feature_names()
    shared = X.deterministic(df, steps=16)
    coefs = R.panel_ols(df, shared.filter("NOT future"), names, "y", ["k"])
    days = pd.date_range("2000-01-01", periods=136)
    full = design(136, days)
    ahead = M.panel_forecast(coefs, shared.filter("future"), names, ["k"], "f").orderBy("k", "date").toPandas()
    for k, part in pdf.groupby("k"):
        y = part.set_index("date").y.reindex(days[:120].date).fillna(0).to_numpy()
        beta = np.linalg.lstsq(full[:120], y, rcond=None)[0]
        assert ahead[ahead.k == k].f.to_numpy() == pytest.approx(full[120:] @ beta, rel=1e-8)


def test_least_squares_by_key(panel):
    pdf, df = panel
    df = W.time_step(df, "date", ["k"])
    got = {r["k"]: r["coef"] for r in R.fit_ols(df, ["time", "p"], "y", ["k"]).collect()}
    for k, part in pdf.groupby("k"):
        x = np.stack([np.ones(len(part)), np.arange(len(part)), part.p], axis=1)
        assert got[k] == pytest.approx(np.linalg.lstsq(x, part.y, rcond=None)[0], rel=1e-8)


def test_residuals_are_orthogonal_and_sum_to_zero(panel):
    _, df = panel
    fitted = R.ols(W.time_step(df, "date", ["k"]), ["time", "p"], "y").toPandas()
    rest = fitted.y - fitted.fitted
    assert abs(rest.sum()) < 1e-7 and abs((rest * fitted.p).sum()) < 1e-6


def test_collinear_inputs_keep_the_fit(panel):
    _, df = panel
    base = R.ols(df, ["p"], "y").orderBy("k", "date").toPandas().fitted
    twice = df.withColumn("q", F.col("p") * 2).withColumn("z", F.lit(0.0))
    assert R.ols(twice, ["p", "q", "z"], "y").orderBy("k", "date").toPandas().fitted.to_numpy() == pytest.approx(base.to_numpy())


def test_normal_solver_agrees(panel):
    _, df = panel
    rows = W.time_step(df, "date", ["k"])
    model = M.tabular_linear(rows, ["time", "p"], "y")
    coef = R.fit_ols(rows, ["time", "p"], "y").first()["coef"]
    assert [model.intercept, *model.coefficients] == pytest.approx(coef, rel=1e-7)


def test_fold_models_equal_refits(panel):
    _, df = panel
    rows = assign_folds(W.time_step(df, "date", ["k"]).withColumn("id", F.monotonically_increasing_id()).cache(), "id", 4)
    got = {r["fold"]: r["rmse"] for r in M.cv_linear(rows, 4, ["time", "p"], "y").collect()}
    for i in range(4):
        coefs = R.fit_ols(rows.filter(F.col("fold") != i), ["time", "p"], "y")
        held = R.predict_ols(rows.filter(F.col("fold") == i), coefs, ["time", "p"])
        assert got[i] == pytest.approx(held.agg(rmse("y", "fitted")).first()[0], rel=1e-8)


def test_lag_promo_model(panel):
    """The whole two-step fit against NumPy for one series without gaps."""
    pdf, df = panel
    out = M.lag_promo_model(df.filter("k = 'a'"), "y", "p", ["k"], holdout=30).orderBy("date").toPandas()
    part = pdf[pdf.k == "a"].reset_index(drop=True)
    x = np.column_stack([design(120, part.date), (pd.to_datetime(part.date).dt.dayofyear == 1).astype(float)])
    left = part.y - x @ np.linalg.lstsq(x, part.y, rcond=None)[0]
    full = np.column_stack([x, left.shift(1), part.p.shift(1), part.p, part.p.shift(-1)])[1:-1]
    y = part.y.to_numpy()[1:-1]
    beta = np.linalg.lstsq(full[:-30], y[:-30], rcond=None)[0]
    assert out.predicted.to_numpy() == pytest.approx(np.clip(full @ beta, 0, None), rel=1e-7)
    assert out.is_test.sum() == 30


def test_periodogram_equals_fft(spark):
    for n in (60, 61):
        y = RNG.normal(size=n) + 0.1 * np.arange(n)
        df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "i long, y double")
        out = S.periodogram(df, "i", "y").orderBy("k").toPandas()
        t = np.arange(n)
        e = y - np.polyval(np.polyfit(t, y, 1), t)
        power = np.abs(np.fft.rfft(e)) ** 2 / n**2
        power[1 : None if n % 2 else -1] *= 2
        assert out.power.to_numpy() == pytest.approx(power, abs=1e-10)
        assert out.power.sum() == pytest.approx(e.var())


def test_periodograms_of_many_lengths_side_by_side(spark):
    """Keys, null among them, with series of one point to a few hundred."""
    lengths = {"a": 1, "b": 2, "c": 3, None: 64, "d": 337}
    rows = {k: RNG.normal(size=n) for k, n in lengths.items()}
    df = spark.createDataFrame([(k, i, float(v)) for k, y in rows.items() for i, v in enumerate(y)], "n string, i long, y double")
    out = S.periodogram(df, "i", "y", ["n"]).toPandas()
    for key, y in rows.items():
        own = out[out.n.isna() if key is None else out.n == key].sort_values("k")
        t, n = np.arange(len(y)), len(y)
        e = y - np.polyval(np.polyfit(t, y, 1), t) if n > 2 else np.zeros(n)
        power = np.abs(np.fft.rfft(e)) ** 2 / n**2
        power[1 : None if n % 2 else -1] *= 2
        assert own.power.to_numpy() == pytest.approx(power, abs=1e-10)


def test_a_long_series_is_transformed_in_pieces(spark):
    """A prime length: more points than any group holds, against one transform of the whole."""
    n = 100_003
    df = spark.range(n).select(F.col("id").alias("t"), F.lit(n).cast("long").alias("n"), F.sin(F.col("id") * F.col("id") % 1009).alias("e"))
    got = squared_spectrum(df, []).orderBy("k").toPandas()
    t = np.arange(n, dtype=np.int64)
    want = np.abs(np.fft.rfft(np.sin(t * t % 1009))) ** 2
    assert got.square.to_numpy() == pytest.approx(want, rel=1e-7, abs=1e-6)


def test_partial_autocorrelation(spark):
    y = np.cumsum(RNG.normal(size=200))
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "i long, y double")
    got = S.pacf(df, "i", "y", 5).orderBy("lag").toPandas().pacf
    z = y - y.mean()
    r = np.array([(z[: 200 - k] * z[k:]).sum() / (z * z).sum() for k in range(6)])
    for k in range(1, 6):
        toeplitz = r[np.abs(np.subtract.outer(np.arange(k), np.arange(k)))]
        assert got[k - 1] == pytest.approx(np.linalg.solve(toeplitz, r[1 : k + 1])[-1])


def test_density_integrates_to_one(spark):
    df = spark.createDataFrame([(float(v),) for v in RNG.normal(size=300)], "v double")
    out = S.kde(df, "v").orderBy("i").toPandas()
    assert np.trapezoid(out.density, out.x) == pytest.approx(1, abs=0.01)


def plain_lowess(x, y, frac, iters):
    n, k = len(x), int(frac * len(x) + 1e-10)
    robust = np.ones(n)
    for step in range(iters + 1):
        fit = np.empty(n)
        for i in range(n):
            far = np.abs(x - x[i])
            h = np.sort(far)[k - 1]
            w = np.where(far < h, (1 - (far / h) ** 3) ** 3, 0) * robust
            a = np.polyfit(x, y, 1, w=np.sqrt(w))
            fit[i] = np.polyval(a, x[i])
        if step < iters:
            miss = np.abs(y - fit)
            robust = np.clip(1 - (miss / (6 * np.median(miss))) ** 2, 0, None) ** 2
    return fit


def test_local_smoother_equals_a_plain_loop(spark):
    x = RNG.normal(size=80)
    y = np.sin(x) + RNG.normal(size=80) * 0.2
    y[3] += 8
    df = spark.createDataFrame([("g", float(a), float(b)) for a, b in zip(x, y)], "g string, x double, y double")
    order = np.lexsort((y, x))
    for iters in (0, 3):
        got = lowess(df, "x", "y", ["g"], iters=iters).orderBy("x", "y").toPandas().smooth
        assert got.to_numpy() == pytest.approx(plain_lowess(x[order], y[order], 2 / 3, iters), abs=1e-6)


@pytest.mark.parametrize("name", ["c12_star_left", "w6_interpolate", "j15_lag_promo_regression", "d19_box_stats_by_family", "k7_fold_ids"])
def test_same_rows_on_any_layout(spark, sf_dir, name):
    from checker import difference, spark_rows

    import __spark_entry__ as entry

    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (1, 13):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            found.append(spark_rows(entry.queries()[name](spark, sf_dir)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert difference(*found) is None
