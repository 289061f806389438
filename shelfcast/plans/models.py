"""Features, models, splits and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfcast.functions.calendar import in_year, new_year
from shelfcast.functions.scalars import clip_low, mixed_key, split_random
from shelfcast.operators import evaluate as K
from shelfcast.operators import features as X
from shelfcast.operators import forecast as M
from shelfcast.operators import regress as R
from shelfcast.operators.joins import align, fill_after_join, join_calendar, merge
from shelfcast.operators.ordered import join_keys
from shelfcast.operators.profile import describe
from shelfcast.operators.smooth import lowess
from shelfcast.operators.stats import ols_line
from shelfcast.operators.windows import lag, moving_avg, time_step
from shelfcast.plans.joining import DAILY_OIL
from shelfcast.plans.registry import doubles, exact_mean, query, round_all
from shelfcast.plans.solving import feature_count, features_sql, mixed_key_sql, solve_sql
from shelfcast.sources import roles
from shelfcast.sources.scratch import stored

YEAR = roles.MODEL_YEAR
LAST_FIT_DAY, FIRST_TEST_DAY = "2000-07-01", "2000-07-02"


def average_daily(spark, d):
    """Mean sale per observed day."""
    return roles.sales(spark, d).groupBy("date").agg(exact_mean("sales").alias("sales"))


def family_daily(spark, d):
    """Mean sale and promotions per family and day of the model year, stored since models read it several times."""
    fact = roles.sales(spark, d).filter(in_year("date", YEAR))
    means = fact.groupBy("family", "date").agg(
        exact_mean("sales").alias("sales"), exact_mean("onpromotion").alias("onpromotion")
    )
    return stored(means, "family-daily")


def panel_year(spark, d):
    return stored(roles.panel_sales(spark, d).filter(in_year("date", YEAR)), "panel")


AVERAGE = "avg_daily AS (SELECT date, exact_mean(sales) AS y, row_number() OVER (ORDER BY date) AS t FROM sales GROUP BY 1)"
FAMILY = f"""fam AS (SELECT family, date, exact_mean(sales) AS y, exact_mean(onpromotion) AS p FROM sales WHERE year(date) = {YEAR} GROUP BY 1, 2),
fam_days AS (SELECT date, row_number() OVER (ORDER BY date) AS t FROM (SELECT DISTINCT date FROM fam))"""


@query(
    "j1_trend_features",
    f"{AVERAGE} SELECT date, t, 1.0::DOUBLE AS const, t::DOUBLE AS trend, t * t::DOUBLE AS trend_2 FROM avg_daily",
)
def j1(spark, d):
    out = X.deterministic(average_daily(spark, d), order=2, seasonal=False, fourier=0)
    return out.drop("future")


@query(
    "j2_weekly_indicators",
    f"{AVERAGE} SELECT date, {', '.join(f'CAST((t - 1) % 7 = {k} AS DOUBLE) AS s_{k + 1}' for k in range(1, 7))} FROM avg_daily",
)
def j2(spark, d):
    out = X.deterministic(average_daily(spark, d), fourier=0)
    return out.select("date", *[f"s_{k}" for k in range(2, 8)])


_PHASE = "(day(date) - 1) / CAST(day(last_day(date)) AS DOUBLE)"


@query(
    "j3_fourier_pairs",
    f"{AVERAGE} SELECT date, "
    + ", ".join(f"round({f}(2 * pi() * {k} * {_PHASE}), 8) + 0.0 AS {f}_{k}" for k in range(1, 5) for f in ("sin", "cos"))
    + " FROM avg_daily",
)
def j3(spark, d):
    out = X.add_fourier(average_daily(spark, d).select("date"))
    cols = [c for c in out.columns if c != "date"]
    return out.select("date", *[(F.round(c, 8) + 0.0).alias(c) for c in cols])


@query(
    "j4_out_of_sample_features",
    f"""{AVERAGE}, ends AS (SELECT max(date) AS d, max(t) AS n FROM avg_daily),
    ahead AS (SELECT CAST(d + CAST(k AS INTEGER) AS DATE) AS date, n + k AS t FROM ends, range(1, 17) r(k))
    SELECT date, t, t::DOUBLE AS trend, CAST((t - 1) % 7 = 3 AS DOUBLE) AS s_4, round(cos(2 * pi() * {_PHASE}), 8) + 0.0 AS cos_1,
    CAST(dayofyear(date) = 1 AS DOUBLE) AS new_year FROM ahead""",
)
def j4(spark, d):
    out = X.deterministic(average_daily(spark, d), with_new_year=True, steps=roles.HORIZON).filter("future")
    return out.select("date", "t", "trend", "s_4", (F.round("cos_1", 8) + 0.0).alias("cos_1"), "new_year")


HOLIDAYS = ["Fair", "Labour Day", "New Year", "Recovery", "Regional day", "Year end"]


def _holiday_flags(spark):
    return X.holiday_indicators(
        roles.holidays_events(spark), ["National", "Regional"], f"{YEAR}-01-01", f"{YEAR}-08-15", HOLIDAYS
    )


_HOLIDAY_CASES = ", ".join(
    f"coalesce(max(CASE WHEN h.description = '{n}' THEN 1.0 END), 0.0)::DOUBLE AS \"hol_{n}\"" for n in HOLIDAYS
)
_FLAGGED = f"""flagged AS (SELECT a.date, a.t, {_HOLIDAY_CASES} FROM (SELECT * FROM avg_daily) a
    LEFT JOIN (SELECT * FROM holidays_events WHERE locale IN ('National', 'Regional')
               AND date BETWEEN DATE '{YEAR}-01-01' AND DATE '{YEAR}-08-15') h ON a.date = h.date GROUP BY 1, 2)"""
_AVERAGE_YEAR = f"""avg_daily AS (SELECT date, exact_mean(sales) AS y, row_number() OVER (ORDER BY date) AS t
    FROM sales WHERE year(date) = {YEAR} GROUP BY 1)"""


@query("j5_holiday_features", f"{_AVERAGE_YEAR}, {_FLAGGED} SELECT * FROM flagged")
def j5(spark, d):
    dates = average_daily(spark, d).filter(in_year("date", YEAR))
    spine = X.deterministic(dates, seasonal=False, fourier=0).select("date", "t")
    return fill_after_join(spine, _holiday_flags(spark))


@query(
    "j6_promo_features",
    f"""{FAMILY} SELECT family, date, lag(p) OVER w AS promo_lag_1, p AS onpromotion,
    lead(p) OVER w AS promo_lead_1 FROM fam WINDOW w AS (PARTITION BY family ORDER BY date)""",
)
def j6(spark, d):
    return X.promo_features(family_daily(spark, d), by=["family"]).drop("sales")


@query(
    "j8_line_on_time",
    f"""{AVERAGE} SELECT date, t - 1 AS time,
    round((SELECT regr_slope(y, t - 1) FROM avg_daily) * (t - 1) + (SELECT regr_intercept(y, t - 1) FROM avg_daily), 4) AS fitted FROM avg_daily""",
)
def j8(spark, d):
    out = R.ols(time_step(average_daily(spark, d), "date"), ["time"], "sales")
    return round_all(out.select("date", "time", "fitted"), 4, "fitted")


@query(
    "j8_line_on_lag",
    f"""{AVERAGE}, l AS (SELECT date, y, lag(y) OVER (ORDER BY date) AS x FROM avg_daily),
    line AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM l)
    SELECT date, round(a + b * x, 4) AS fitted FROM l, line WHERE x IS NOT NULL""",
)
def j8_lag(spark, d):
    daily = average_daily(spark, d)
    features = lag(daily, "date", "sales", 1, out="lag_1").select("date", "lag_1").dropna()
    out = R.ols(align(daily, features), ["lag_1"], "sales")
    return round_all(out.select("date", "fitted"), 4, "fitted")


_JOINT = """x_rows AS (SELECT {g} AS g, sales AS y, CAST([1, onpromotion / 10.0, transactions, dcoilwtico / 100] AS DOUBLE[]) AS x
    FROM sales JOIN oil USING (date) JOIN transactions USING (date, store_nbr) WHERE dcoilwtico IS NOT NULL)"""
_BETA_ROWS = """unnest(['intercept', 'onpromotion', 'transactions', 'dcoilwtico']) AS feature,
    unnest([round(beta[1], 3), round(beta[2] / 10, 3), round(beta[3], 3), round(beta[4] / 100, 3)]) AS coef"""
_JOINT_FEATURES = ["onpromotion", "transactions", "dcoilwtico"]


def _joint(spark, d):
    priced = join_calendar(roles.sales(spark, d), roles.oil(spark, d))
    return merge(priced, roles.transactions(spark, d), ["date", "store_nbr"])


@query("j9_least_squares", f"{_JOINT.format(g='0')}, {solve_sql('model', 'x_rows', 'g', 4)} SELECT {_BETA_ROWS} FROM model")
def j9(spark, d):
    coefs = R.fit_ols(_joint(spark, d), _JOINT_FEATURES, "sales")
    return round_all(R.coefficient_rows(coefs, _JOINT_FEATURES), 3, "coef")


@query(
    "j9_least_squares_by_family",
    f"{_JOINT.format(g='family')}, {solve_sql('model', 'x_rows', 'g', 4)} SELECT g AS family, {_BETA_ROWS} FROM model",
)
def j9_by_family(spark, d):
    coefs = R.fit_ols(_joint(spark, d), _JOINT_FEATURES, "sales", ["family"])
    return round_all(R.coefficient_rows(coefs, _JOINT_FEATURES, ["family"]), 3, "coef")


@query(
    "j10_trend_forecast",
    f"""{AVERAGE}, line AS (SELECT regr_slope(y, t) AS b, regr_intercept(y, t) AS a, max(date) AS d, max(t) AS n FROM avg_daily)
    SELECT CAST(d + CAST(k AS INTEGER) AS DATE) AS date, round(a + b * (n + k), 4) AS sales FROM line, range(1, 31) r(k)""",
)
def j10(spark, d):
    daily = average_daily(spark, d)
    spine = X.deterministic(daily, seasonal=False, fourier=0, steps=30)
    coefs = R.fit_ols(spine.join(daily, "date"), ["const", "trend"], "sales", intercept=False)
    out = R.predict_ols(spine.filter("future"), coefs, ["const", "trend"], intercept=False, out="sales")
    return round_all(out.select("date", "sales"), 4, "sales")


@query(
    "j11_deseasonalise",
    f"""{AVERAGE}, x_rows AS (SELECT 0 AS g, date, y, {features_sql()} AS x FROM avg_daily),
    {solve_sql('model', 'x_rows', 'g', feature_count())}
    SELECT date, round(y - list_dot_product(beta, x), 4) AS deseasoned FROM x_rows JOIN model USING (g)""",
)
def j11(spark, d):
    daily = average_daily(spark, d)
    # A constant beside an intercept adds nothing, so it is left out of the fit.
    rows = join_calendar(daily, X.deterministic(daily).drop("t", "future"))
    names = [n for n in X.feature_names() if n != "const"]
    out = R.ols(rows, names, "sales").withColumn("deseasoned", F.col("sales") - F.col("fitted"))
    return round_all(out.select("date", "deseasoned"), 4, "deseasoned")


_HOLIDAY_LIST = ", ".join(f'f."hol_{n}"' for n in HOLIDAYS)


@query(
    "j12_seasonal_holiday_model",
    f"""{_AVERAGE_YEAR}, {_FLAGGED},
    x_rows AS (SELECT 0 AS g, a.date, a.y, list_concat(a.x, [{_HOLIDAY_LIST}]) AS x
               FROM (SELECT *, {features_sql()} AS x FROM avg_daily) a JOIN flagged f ON a.date = f.date),
    {solve_sql('model', 'x_rows', 'g', feature_count() + len(HOLIDAYS))}
    SELECT date, round(list_dot_product(beta, x), 4) AS fitted FROM x_rows JOIN model USING (g)""",
)
def j12(spark, d):
    daily = average_daily(spark, d).filter(in_year("date", YEAR))
    flags = _holiday_flags(spark)
    features = fill_after_join(X.deterministic(daily).drop("t", "future", "const"), flags)
    rows = join_calendar(daily, features)
    out = R.ols(rows, [c for c in features.columns if c != "date"], "sales")
    return round_all(out.select("date", "fitted"), 4, "fitted")


_PANEL = f"""days AS (SELECT date, row_number() OVER (ORDER BY date) AS t FROM
        (SELECT DISTINCT date FROM panel_sales WHERE year(date) = {YEAR})),
    dated AS (SELECT date, {features_sql(new_year=True)} AS x FROM days),
    x_rows AS (SELECT k.store_nbr, k.family, d.date, d.x, coalesce(s.sales, 0) AS y
        FROM (SELECT DISTINCT store_nbr, family FROM panel_sales WHERE year(date) = {YEAR}) k, dated d
        LEFT JOIN panel_sales s ON s.store_nbr = k.store_nbr AND s.family = k.family AND s.date = d.date),
    {solve_sql('model', 'x_rows', 'store_nbr, family', feature_count(new_year=True))}"""
PANEL_KEYS = ["store_nbr", "family"]
PANEL_FEATURES = X.feature_names(with_new_year=True)


def panel_model(spark, d):
    fact = panel_year(spark, d)
    shared = X.deterministic(fact, with_new_year=True, steps=roles.HORIZON)
    coefs = R.panel_ols(fact, shared.filter(~F.col("future")), PANEL_FEATURES, "sales", PANEL_KEYS)
    return fact, shared, coefs


@query(
    "j13_panel_model",
    f"""{_PANEL} SELECT x.store_nbr, x.family, x.date, round(list_dot_product(beta, x), 3) AS fitted
    FROM x_rows x JOIN model m ON x.store_nbr = m.store_nbr AND x.family = m.family
    JOIN panel_sales s ON s.store_nbr = x.store_nbr AND s.family = x.family AND s.date = x.date""",
)
def j13(spark, d):
    fact, shared, coefs = panel_model(spark, d)
    rows = join_calendar(fact, shared.select("date", *PANEL_FEATURES))
    out = R.predict_ols(rows, coefs, PANEL_FEATURES, PANEL_KEYS, False)
    return round_all(out.select("store_nbr", "family", "date", "fitted"), 3, "fitted")


@query(
    "j14_panel_forecast",
    f"""{_PANEL}, ends AS (SELECT max(date) AS d, max(t) AS n FROM days),
    ahead AS (SELECT CAST(d + CAST(k AS INTEGER) AS DATE) AS date, n + k AS t FROM ends, range(1, 17) r(k)),
    ahead_x AS (SELECT date, {features_sql(new_year=True)} AS x FROM ahead)
    SELECT store_nbr, family, date, round(list_dot_product(beta, x), 3) AS sales FROM model, ahead_x""",
)
def j14(spark, d):
    _, shared, coefs = panel_model(spark, d)
    out = M.panel_forecast(coefs, shared.filter("future"), PANEL_FEATURES, PANEL_KEYS)
    return round_all(out, 3, "sales")


_DESEASON = f"""{FAMILY},
    fam_x AS (SELECT date, {features_sql(new_year=True)} AS x FROM fam_days),
    x_rows AS (SELECT k.family, d.date, d.x, f.y AS seen, f.p, coalesce(f.y, 0) AS y
        FROM (SELECT DISTINCT family FROM fam) k, fam_x d LEFT JOIN fam f ON f.family = k.family AND f.date = d.date),
    {solve_sql('season', 'x_rows', 'family', feature_count(new_year=True))},
    left_over AS (SELECT family, date, x, y, p, y - list_dot_product(beta, x) AS e FROM x_rows JOIN season USING (family)
        WHERE seen IS NOT NULL)"""
LAG_PROMO = f"""{_DESEASON},
    around AS (SELECT *, lag(e) OVER w AS e_lag, lag(p) OVER w AS p_lag, lead(p) OVER w AS p_lead FROM left_over
        WINDOW w AS (PARTITION BY family ORDER BY date)),
    marked AS (SELECT family, date, y, list_concat(x, [e_lag / 10000, p_lag / 10, p / 10, p_lead / 10]) AS x,
        row_number() OVER (PARTITION BY family ORDER BY date DESC) <= 30 AS is_test FROM around
        WHERE e_lag IS NOT NULL AND p_lag IS NOT NULL AND p_lead IS NOT NULL),
    fit_rows AS (SELECT * FROM marked WHERE NOT is_test),
    {solve_sql('model', 'fit_rows', 'family', feature_count(new_year=True) + 4)},
    predicted AS (SELECT family, date, y, greatest(list_dot_product(beta, x), 0) AS predicted, is_test
        FROM marked JOIN model USING (family))"""


@query("j15_lag_promo_regression", f"{LAG_PROMO} SELECT family, date, round(predicted, 3) AS predicted, is_test FROM predicted")
def j15(spark, d):
    out = M.lag_promo_model(family_daily(spark, d), "sales", "onpromotion", ["family"])
    return round_all(out.select("family", "date", "predicted", "is_test"), 3, "predicted")


def numbered_family_daily(spark, d):
    """The family series with the day number of the shared date index."""
    series = family_daily(spark, d)
    steps = X.deterministic(series, constant=False, seasonal=False, fourier=0).select("date", "t")
    return join_calendar(series, steps)


@query(
    "j16_hybrid_first_stage",
    f"""{FAMILY} SELECT family, round(regr_slope(y, t), 4) AS slope, round(regr_intercept(y, t), 3) AS intercept
    FROM fam JOIN fam_days USING (date) WHERE date <= DATE '{LAST_FIT_DAY}' GROUP BY 1""",
)
def j16_first(spark, d):
    rows = numbered_family_daily(spark, d).filter(F.col("date") <= F.lit(LAST_FIT_DAY).cast("date"))
    out = ols_line(rows, "t", "sales", ["family"]).select("family", "slope", "intercept")
    return round_all(round_all(out, 4, "slope"), 3, "intercept")


@query("j16_hybrid_forecast")
def j16(spark, d):
    """Boosted trees differ between libraries; tests check that the second stage improves on the first."""
    rows = K.holdout_from(numbered_family_daily(spark, d), "date", FIRST_TEST_DAY)
    model = M.hybrid_fit(rows.filter(~F.col("is_test")))
    return model.predict(rows).select("family", "date", "sales", "stage_1", "predicted", "is_test")


def tabular(spark, d):
    """The model table with its test marks, written once since fits and scores read it again and again."""
    frame = M.tabular_frame(roles.sales(spark, d), roles.oil(spark, d), roles.families(spark, d))
    return stored(split_random(frame, "id"), "tabular")


def tabular_split(spark, d):
    rows = tabular(spark, d)
    return rows.filter(~F.col("is_test")), rows.filter("is_test")


TABULAR = f"""{DAILY_OIL},
    tab AS (SELECT id, sales AS y, {mixed_key_sql('id', 42)} % 10000 < 2000 AS is_test,
        CAST([1, id / 1e15, family_code, onpromotion / 10.0, isodow(date) - 1, month(date), dcoilwtico / 100,
              CASE WHEN isodow(date) > 5 THEN 1 ELSE 0 END] AS DOUBLE[]) AS x
        FROM sales JOIN daily_oil USING (date) JOIN families USING (family)),
    fit_rows AS (SELECT 0 AS g, x, y FROM tab WHERE NOT is_test),
    {solve_sql('model', 'fit_rows', 'g', 8)}"""


@query(
    "j17_tabular_linear",
    f"{TABULAR} SELECT id, round(list_dot_product(beta, x), 2) AS predicted FROM tab, model WHERE is_test",
)
def j17(spark, d):
    train, test = tabular_split(spark, d)
    scored = M.tabular_linear(train).transform(M.assemble(test))
    return round_all(scored.select("id", "predicted"), 2, "predicted")


@query("j18_tabular_boosted")
def j18(spark, d):
    """Scores of boosted trees on both parts."""
    train, test = tabular_split(spark, d)
    model = M.tabular_boosted(train)
    parts = [
        K.scores(model.transform(part), "sales", "predicted").withColumn("part", F.lit(name))
        for name, part in (("train", train), ("test", test))
    ]
    return parts[0].unionByName(parts[1])


_SCATTER = f"""{FAMILY}, pts AS (SELECT family, lag(y) OVER (PARTITION BY family ORDER BY date) AS x, y FROM fam),
    known AS (SELECT *, count(*) OVER (PARTITION BY family) AS n FROM pts WHERE x IS NOT NULL),
    pairs AS (SELECT a.family, a.x AS x0, a.y AS y0, b.x - a.x AS g, b.y, a.n,
        row_number() OVER (PARTITION BY a.family, a.x, a.y ORDER BY abs(b.x - a.x)) AS r
        FROM known a JOIN known b ON a.family = b.family),
    near AS (SELECT family, x0, y0, max(abs(g)) AS h FROM pairs WHERE r <= floor(2 / 3.0 * n + 1e-10) GROUP BY ALL),
    w AS (SELECT p.family, p.x0, p.y0, g, y, CASE WHEN abs(g) < h THEN pow(1 - pow(abs(g) / h, 3), 3) ELSE 0 END AS w
        FROM pairs p JOIN near USING (family, x0, y0)),
    m AS (SELECT family, x0, y0, sum(w * g) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM w GROUP BY ALL),
    s AS (SELECT family, x0, y0, any_value(mx) AS mx, any_value(my) AS my,
        sum(w * (g - mx) * y) / sum(w * (g - mx) * (g - mx)) AS b FROM w JOIN m USING (family, x0, y0) GROUP BY ALL)"""


def lag_scatter(spark, d):
    return lag(family_daily(spark, d), "date", "sales", 1, ["family"], "x").withColumnRenamed("sales", "y")


@query(
    "j21_local_smoother",
    f"{_SCATTER} SELECT family, x0 AS x, y0 AS y, round(my - b * mx, 4) AS smooth FROM s",
)
def j21(spark, d):
    out = lowess(lag_scatter(spark, d), "x", "y", ["family"], iters=0)
    return round_all(out, 4, "smooth")


@query("j21_local_smoother_robust")
def j21_robust(spark, d):
    """With three robust passes; tests compare it with a plain loop."""
    return lowess(lag_scatter(spark, d), "x", "y", ["family"])


_MA7 = "OVER (PARTITION BY family ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"


@query(
    "j22_cycle_frame",
    f"""{_DESEASON} SELECT family, date, round(e, 3) AS deseasoned,
    CASE WHEN count(y) {_MA7} = 7 THEN
        CAST((20000 * sum(CAST(round(y * 1e6) AS BIGINT)) {_MA7} + 7) // 14 AS DOUBLE) / 1e10 END AS ma_7 FROM left_over""",
)
def j22(spark, d):
    left, _ = M.seasonal_residual(family_daily(spark, d), "sales", ["family"])
    left = left.withColumn("sales", F.col("sales").cast("decimal(18,6)"))  # the daily means have six places
    out = moving_avg(left, "date", "sales", 7, by=["family"], out="ma_7")
    out = out.select("family", "date", "deseasoned", "ma_7")
    return doubles(round_all(out, 3, "deseasoned"), "ma_7")


# Splits and scores.


def _family_mean_prediction(spark, d):
    """Sales with their family's mean; the means are stored, so their size is known before the sales move."""
    fact = stored(roles.sales(spark, d).select("id", "date", "family", "sales"), "scored-sales")
    means = fact.groupBy("family").agg(F.avg("sales").alias("predicted"))
    return join_keys(fact, stored(means, "family-means"), ["family"])


_FAMILY_MEAN = """scored AS (SELECT id, date, family, sales, avg(sales) OVER (PARTITION BY family) AS predicted FROM sales)"""


@query("k1_rmse", f"{_FAMILY_MEAN} SELECT round(sqrt(avg(pow(sales - predicted, 2))), 6) AS rmse FROM scored")
def k1(spark, d):
    return _family_mean_prediction(spark, d).agg(F.round(K.rmse("sales", "predicted"), 6).alias("rmse"))


@query("k2_rmsle", f"{_FAMILY_MEAN} SELECT round(sqrt(avg(pow(ln(1 + sales) - ln(1 + predicted), 2))), 8) AS rmsle FROM scored")
def k2(spark, d):
    clipped = _family_mean_prediction(spark, d).withColumn("predicted", clip_low("predicted"))
    return clipped.agg(F.round(K.rmsle("sales", "predicted"), 8).alias("rmsle"))


@query(
    "k3_r2_train_and_test",
    f"""{TABULAR}, scored AS (SELECT is_test, y, list_dot_product(beta, x) AS p FROM tab, model)
    SELECT is_test, round(1 - sum(pow(y - p, 2)) / (var_pop(y) * count(*)), 8) AS r2, round(sqrt(avg(pow(y - p, 2))), 4) AS rmse, count(*) AS n
    FROM scored GROUP BY 1""",
)
def k3(spark, d):
    rows = tabular(spark, d)
    model = M.tabular_linear(rows.filter(~F.col("is_test")))
    out = K.scores(model.transform(M.assemble(rows)), "sales", "predicted", ["is_test"])
    return round_all(round_all(out, 8, "r2"), 4, "rmse")


@query(
    "k4_holdout_last_rows",
    f"""{FAMILY} SELECT family, date, row_number() OVER (PARTITION BY family ORDER BY date DESC) <= 30 AS is_test FROM fam""",
)
def k4(spark, d):
    return K.holdout_last(family_daily(spark, d), "date", 30, ["family"]).select("family", "date", "is_test")


@query(
    "k4_holdout_last_rows_of_table",
    "SELECT id, row_number() OVER (ORDER BY id DESC) <= 1000 AS is_test FROM sales",
)
def k4_table(spark, d):
    return K.holdout_last(roles.sales(spark, d).select("id"), "id", 1000)


@query(
    "k5_holdout_by_date",
    f"SELECT date >= DATE '{FIRST_TEST_DAY}' AS is_test, count(*) AS n, min(date) AS first, max(date) AS last FROM sales WHERE year(date) = {YEAR} GROUP BY 1",
)
def k5(spark, d):
    marked = K.holdout_from(roles.sales(spark, d).filter(in_year("date", YEAR)), "date", FIRST_TEST_DAY)
    return marked.groupBy("is_test").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))


@query("k6_random_split", f"SELECT id, {mixed_key_sql('id', 42)} % 10000 < 2000 AS is_test FROM sales")
def k6(spark, d):
    return split_random(roles.sales(spark, d).select("id"), "id")


def folded(spark, d, k: int = 10):
    """Training rows in scrambled order, cut into k folds."""
    train, _ = tabular_split(spark, d)
    return K.assign_folds(train.withColumn("_mix", mixed_key("id", 7)), "_mix", k, then=["id"])


_FOLDS = f"folds AS (SELECT id, y, x, ntile(10) OVER (ORDER BY {mixed_key_sql('id', 7)}, id) - 1 AS fold FROM tab WHERE NOT is_test)"


@query("k7_fold_ids", f"{TABULAR}, {_FOLDS} SELECT id, fold FROM folds")
def k7(spark, d):
    return folded(spark, d).select("id", F.col("fold").cast("bigint").alias("fold"))


@query(
    "k7_cross_validation_linear",
    f"""{TABULAR}, {_FOLDS}, others AS (SELECT k.fold, f.x, f.y FROM folds f JOIN range(10) k(fold) ON f.fold <> k.fold),
    {solve_sql('cv', 'others', 'fold', 8)}
    SELECT f.fold, round(sqrt(avg(pow(y - list_dot_product(beta, x), 2))), 4) AS rmse, count(*) AS n
    FROM folds f JOIN cv ON f.fold = cv.fold GROUP BY 1""",
)
def k7_linear(spark, d):
    return round_all(M.cv_linear(folded(spark, d)), 4, "rmse").withColumn("fold", F.col("fold").cast("bigint"))


@query(
    "k7_mean_over_folds",
    f"""{TABULAR}, {_FOLDS}, others AS (SELECT k.fold, f.x, f.y FROM folds f JOIN range(10) k(fold) ON f.fold <> k.fold),
    {solve_sql('cv', 'others', 'fold', 8)},
    scored AS (SELECT f.fold, sqrt(avg(pow(y - list_dot_product(beta, x), 2))) AS rmse FROM folds f JOIN cv ON f.fold = cv.fold GROUP BY 1)
    SELECT round(avg(rmse), 4) AS rmse, count(*) AS folds FROM scored""",
)
def k7_mean(spark, d):
    return round_all(K.mean_over_folds(M.cv_linear(folded(spark, d))), 4, "rmse")


@query("k7_cross_validation_boosted")
def k7_boosted(spark, d):
    return M.cv_boosted(folded(spark, d))


@query(
    "k8_describe_predictions",
    f"""{_PANEL}, ends AS (SELECT max(date) AS d, max(t) AS n FROM days),
    ahead AS (SELECT CAST(d + CAST(k AS INTEGER) AS DATE) AS date, n + k AS t FROM ends, range(1, 17) r(k)),
    ahead_x AS (SELECT date, {features_sql(new_year=True)} AS x FROM ahead),
    fc AS (SELECT list_dot_product(beta, x) AS s FROM model, ahead_x)
    SELECT 'sales' AS "column", count(*) AS count, round(avg(s), 3) AS mean, round(stddev_samp(s), 3) AS std, round(min(s), 3) AS min,
    round(max(s), 3) AS max, round(quantile_cont(s, 0.25), 3) AS q25, round(quantile_cont(s, 0.5), 3) AS q50,
    round(quantile_cont(s, 0.75), 3) AS q75, count(*) FILTER (s < 0) AS negative FROM fc""",
)
def k8(spark, d):
    _, shared, coefs = panel_model(spark, d)
    out = M.panel_forecast(coefs, shared.filter("future"), PANEL_FEATURES, PANEL_KEYS)
    told = round_all(describe(out, ["sales"]), 3, "mean", "std", "min", "max", "q25", "q50", "q75")
    return told.withColumn("negative", out.agg(F.count_if(F.col("sales") < 0)).scalar())


@query(
    "b16_new_year_effect",
    "SELECT dayofyear(date) = 1 AS new_year, exact_mean(sales) AS sales FROM sales GROUP BY 1",
)
def new_year_effect(spark, d):
    return roles.sales(spark, d).groupBy(new_year("date").alias("new_year")).agg(exact_mean("sales").alias("sales"))
