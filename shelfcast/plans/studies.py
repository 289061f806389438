"""End-to-end analyses."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfcast.functions import calendar as cal
from shelfcast.functions.scalars import clip_low, null_sentinel, recode
from shelfcast.operators import evaluate as K
from shelfcast.operators import forecast as M
from shelfcast.operators import joins as J
from shelfcast.operators import profile as P
from shelfcast.operators import stats as S
from shelfcast.operators.reshape import encode_first_seen
from shelfcast.operators.resample import resample
from shelfcast.operators.windows import interpolate
from shelfcast.plans import models
from shelfcast.plans.basics import HOLIDAY_TYPE_CODES, LOCALE_CODES, STORE_TYPE_CODES
from shelfcast.plans.joining import DAILY_OIL
from shelfcast.plans.models import LAG_PROMO, PANEL_FEATURES, PANEL_KEYS, TABULAR, _PANEL
from shelfcast.plans.registry import doubles, exact, exact_mean, query, round_all, spine_sql
from shelfcast.plans.solving import features_sql
from shelfcast.plans.time_axis import _fill_sql
from shelfcast.sources import roles, tables
from shelfcast.sources.scratch import new_path, stored


@query(
    "q1_monthly_sales_vs_promotions",
    """m AS (SELECT last_day(date) AS date, exact_mean(sales) AS sales, exact_mean(onpromotion) AS onpromotion FROM sales GROUP BY 1),
    line AS (SELECT regr_slope(sales, onpromotion) AS b, regr_intercept(sales, onpromotion) AS a, regr_r2(sales, onpromotion) AS r2 FROM m)
    SELECT date, sales, onpromotion,
    round(a + b * onpromotion, 4) AS trend, round(r2, 6) AS r2 FROM m, line""",
)
def q1(spark, d):
    fact = exact(roles.sales(spark, d), "sales", "onpromotion")
    months = doubles(resample(fact, "M", {"sales": "mean", "onpromotion": "mean"}), "sales", "onpromotion")
    line = S.ols_line(months, "onpromotion", "sales").select(F.struct("slope", "intercept", "r2")).scalar()
    return months.withColumn("l", line).select(
        "date",
        "sales",
        "onpromotion",
        F.round(F.col("l.intercept") + F.col("l.slope") * F.col("onpromotion"), 4).alias("trend"),
        F.round("l.r2", 6).alias("r2"),
    )


_HEAT = ", ".join(f'exact_mean(CASE WHEN month(date) = {m} THEN transactions END) AS "{m}"' for m in range(1, 13))


@query("q2_weekday_by_month_table", f"SELECT dayname(date) AS day_name, {_HEAT} FROM transactions GROUP BY 1")
def q2(spark, d):
    dated = cal.add_calendar(exact(roles.transactions(spark, d), "transactions"))
    out = P.pivot_mean(dated, "day_name", "month", "transactions", range(1, 13), cal.WEEKDAYS)
    return doubles(out, *[str(m) for m in range(1, 13)])


@query(
    "q3_sales_on_moved_holidays",
    """per_store AS (SELECT date, store_nbr, exact_mean(sales) AS sales FROM sales GROUP BY 1, 2),
    per_day AS (SELECT date, CAST(sum(CAST(sales AS DECIMAL(18,6))) AS DOUBLE) AS sales FROM per_store GROUP BY 1),
    m AS (SELECT avg(sales) AS mean_day FROM per_day)
    SELECT date, sales, round(mean_day, 4) AS mean_day, sales > mean_day AS above
    FROM per_day, m WHERE date IN (SELECT date FROM holidays_events WHERE type = 'Transfer')""",
)
def q3(spark, d):
    per_store = exact(roles.sales(spark, d), "sales").groupBy("date", "store_nbr").agg(F.avg("sales").alias("sales"))
    per_day = per_store.groupBy("date").agg(F.sum("sales").cast("double").alias("sales"))
    moved = roles.holidays_events(spark).filter(F.col("type") == "Transfer")
    out = J.sales_on_dates(per_day, moved).withColumn("mean_day", per_day.agg(F.avg("sales")).scalar())
    out = out.withColumn("above", F.col("sales") > F.col("mean_day"))
    return round_all(out, 4, "mean_day")


@query(
    "q4_sales_vs_oil",
    f"""{DAILY_OIL}, prices AS (SELECT last_day(date) AS date, avg(dcoilwtico) AS dcoilwtico FROM daily_oil GROUP BY 1),
    m AS (SELECT last_day(date) AS date, avg(sales) AS sales FROM sales GROUP BY 1),
    j AS (SELECT m.date, sales, dcoilwtico FROM m LEFT JOIN prices p ON m.date = p.date)
    SELECT round(regr_slope(sales, dcoilwtico), 4) AS slope, round(regr_intercept(sales, dcoilwtico), 3) AS intercept,
    round(regr_r2(sales, dcoilwtico), 6) AS r2, CAST(regr_count(sales, dcoilwtico) AS BIGINT) AS n FROM j""",
)
def q4(spark, d):
    prices = resample(M.daily_oil(roles.oil(spark, d)), "M", {"dcoilwtico": "mean"})
    months = J.merge(resample(roles.sales(spark, d), "M", {"sales": "mean"}), prices, "date", "left")
    out = S.ols_line(months, "dcoilwtico", "sales")
    return round_all(round_all(round_all(out, 4, "slope"), 3, "intercept"), 6, "r2")


@query(
    "q5_store_sales_vs_transactions",
    f"""t AS (SELECT s.store_nbr, s.date, coalesce(x.transactions, 0) AS transactions
    FROM {spine_sql('transactions', 'store_nbr')} s LEFT JOIN transactions x ON s.store_nbr = x.store_nbr AND s.date = x.date),
    j AS (SELECT a.sales, CAST(t.transactions AS DOUBLE) AS transactions
          FROM (SELECT date, store_nbr, sum(sales) AS sales FROM sales GROUP BY 1, 2) a LEFT JOIN t USING (date, store_nbr))
    SELECT round(regr_slope(sales, transactions), 4) AS slope, round(regr_intercept(sales, transactions), 4) AS intercept,
    round(regr_r2(sales, transactions), 8) AS r2, CAST(regr_count(sales, transactions) AS BIGINT) AS n FROM j""",
)
def q5(spark, d):
    per_day = roles.sales(spark, d).groupBy("date", "store_nbr").agg(F.sum("sales").alias("sales"))
    visits = resample(roles.transactions(spark, d), "D", {"transactions": "sum"}, by=["store_nbr"])
    out = S.ols_line(J.natural_join(per_day, visits), "transactions", "sales")
    return round_all(round_all(out, 4, "slope", "intercept"), 8, "r2")


@query(
    "q6_cluster_year_means",
    """j AS (SELECT t.cluster, year(s.date) AS year, s.sales, x.transactions FROM stores t JOIN sales s USING (store_nbr)
    JOIN transactions x ON s.date = x.date AND s.store_nbr = x.store_nbr)
    SELECT cluster, year, exact_mean(sales) AS sales, exact_mean(transactions) AS transactions FROM j GROUP BY 1, 2""",
)
def q6(spark, d):
    sold = J.merge(roles.stores(spark, d), roles.sales(spark, d), "store_nbr", "left")
    both = J.merge(sold, roles.transactions(spark, d), ["date", "store_nbr"], "left")
    both = both.withColumn("year", F.year("date").cast("bigint")).na.drop(how="any")
    return P.group_agg(
        both, ["cluster", "year"], exact_mean("sales").alias("sales"), exact_mean("transactions").alias("transactions")
    )


@query(
    "q7_bridge_day_families",
    """SELECT family, exact_mean(sales) AS sales FROM sales s JOIN holidays_events h USING (date)
    WHERE h.type = 'Bridge' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
)
def q7(spark, d):
    bridge = roles.holidays_events(spark).filter(F.col("type") == "Bridge")
    means = P.group_agg(J.join_calendar(roles.sales(spark, d), bridge), "family", exact_mean("sales").alias("sales"))
    return means.orderBy(F.desc("sales"), F.asc("family")).limit(10)


_Q8_COLS = ["store_nbr", "family", "sales", "onpromotion", "type_x", "locale", "transferred", "dcoilwtico", "type_y", "transactions"]
_MODE = "(SELECT {c} FROM merged WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


def _codes_sql(col, codes):
    whens = " ".join(f"WHEN '{k}' THEN {v}" for k, v in codes.items())
    return f"CAST(CASE coalesce({col}, {_MODE.format(c=col)}) {whens} END AS DOUBLE) AS {col}"


@query(
    "q8_merged_correlations",
    f"""merged AS (SELECT s.id, s.store_nbr, s.family, s.sales, s.onpromotion, h.type AS type_x, h.locale, h.transferred,
        nullif(o.dcoilwtico, 0) AS price, t.type AS type_y, x.transactions
    FROM sales s LEFT JOIN holidays_events h ON s.date = h.date LEFT JOIN oil o ON s.date = o.date
    LEFT JOIN stores t ON s.store_nbr = t.store_nbr LEFT JOIN transactions x ON s.date = x.date AND s.store_nbr = x.store_nbr),
    {_fill_sql('merged', 'price', "id, coalesce(type_x, '')", 'pv')},
    seen AS (SELECT family, row_number() OVER (ORDER BY min(id)) AS code FROM sales GROUP BY 1),
    coded AS (SELECT CAST(store_nbr AS DOUBLE) AS store_nbr, CAST(code AS DOUBLE) AS family, sales, CAST(onpromotion AS DOUBLE) AS onpromotion,
        {_codes_sql('type_x', HOLIDAY_TYPE_CODES)}, {_codes_sql('locale', LOCALE_CODES)},
        CAST(coalesce(transferred, {_MODE.format(c='transferred')}) AS DOUBLE) AS transferred, f AS dcoilwtico,
        {_codes_sql('type_y', STORE_TYPE_CODES)},
        coalesce(CAST(transactions AS DOUBLE), (SELECT quantile_cont(CAST(transactions AS DOUBLE), 0.5) FROM merged)) AS transactions
        FROM filled JOIN seen USING (family)) """
    + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM coded" for a in _Q8_COLS for b in _Q8_COLS),
)
def q8(spark, d):
    fact = encode_first_seen(roles.sales(spark, d), "family", "id", "family_code", points=[])
    merged = J.star_left(
        fact, roles.holidays_events(spark), roles.oil(spark, d), roles.stores(spark, d), roles.transactions(spark, d)
    )
    merged = merged.withColumn("transactions", F.col("transactions").cast("double"))
    merged = stored(merged.select("id", "family_code", *[c for c in _Q8_COLS if c != "family"]), "merged")
    filled = P.impute(merged, modes=["type_x", "locale", "transferred"], medians=["transactions"])
    # Two holiday rows on a date share the id, so the holiday's code is put behind it to make the row order unique.
    types = F.coalesce(F.array_position(F.lit(sorted(HOLIDAY_TYPE_CODES)), F.col("type_x")), F.lit(0))
    filled = filled.withColumns({"row_nbr": F.col("id") * 10 + types, "dcoilwtico": null_sentinel("dcoilwtico", 0.0)})
    filled = interpolate(filled, "row_nbr", "dcoilwtico")
    for col, codes in (("locale", LOCALE_CODES), ("type_y", STORE_TYPE_CODES), ("type_x", HOLIDAY_TYPE_CODES)):
        filled = recode(filled, col, codes)
    coded = filled.withColumn("family", F.col("family_code")).withColumn("transferred", F.col("transferred").cast("int"))
    return round_all(P.corr_matrix(coded, _Q8_COLS), 6, "corr")


@query(
    "q9_panel_submission",
    f"""{_PANEL}, ends AS (SELECT max(date) AS d, max(t) AS n FROM days),
    ahead AS (SELECT CAST(d + CAST(k AS INTEGER) AS DATE) AS date, n + k AS t FROM ends, range(1, 17) r(k)),
    ahead_x AS (SELECT date, {features_sql(new_year=True)} AS x FROM ahead)
    SELECT (datediff('day', DATE '1995-01-01', date) * 10000000000 + store_nbr) * 10 + family_code AS id,
    round(list_dot_product(beta, x), 3) AS sales FROM model JOIN families USING (family), ahead_x""",
)
def q9(spark, d):
    """Panel forecast of the days after the model year, put to ids and written as a submission."""
    fact, shared, coefs = models.panel_model(spark, d)
    forecast = M.panel_forecast(coefs, shared.filter("future"), PANEL_FEATURES, PANEL_KEYS)
    nations = fact.select("store_nbr").distinct()
    wanted = roles.test(spark, d, fact, nations)
    path = new_path(spark, "submission")
    tables.write_submission(M.forecast_to_ids(forecast, wanted), path)
    schema = tables.StructType([f for f in tables.SCHEMAS["train"] if f.name in ("id", "sales")])
    return round_all(spark.read.schema(schema).option("header", True).csv(path), 3, "sales")


@query(
    "q10_lag_promo_scores",
    f"""{LAG_PROMO} SELECT family, is_test, round(sqrt(avg(pow(ln(1 + y) - ln(1 + predicted), 2))), 7) AS rmsle, count(*) AS n
    FROM predicted GROUP BY 1, 2""",
)
def q10(spark, d):
    out = M.lag_promo_model(models.family_daily(spark, d), "sales", "onpromotion", ["family"])
    scored = out.groupBy("family", "is_test").agg(K.rmsle("sales", "predicted").alias("rmsle"), F.count(F.lit(1)).alias("n"))
    return round_all(scored, 7, "rmsle")


@query("q11_hybrid_scores")
def q11(spark, d):
    """Errors of both stages on either side of the split date."""
    scored = models.j16(spark, d).withColumn("stage_1", clip_low("stage_1"))
    return scored.groupBy("is_test").agg(
        K.rmsle("sales", "stage_1").alias("rmsle_stage_1"),
        K.rmsle("sales", "predicted").alias("rmsle"),
        K.rmse("sales", "stage_1").alias("rmse_stage_1"),
        K.rmse("sales", "predicted").alias("rmse"),
        F.count(F.lit(1)).alias("n"),
    )


_TEST_X = """SELECT t.id, CAST([1, t.id / 1e15, family_code, t.onpromotion / 10.0, isodow(t.date) - 1, month(t.date), dcoilwtico / 100,
    CASE WHEN isodow(t.date) > 5 THEN 1 ELSE 0 END] AS DOUBLE[]) AS x
    FROM test t JOIN families USING (family), (SELECT dcoilwtico FROM daily_oil ORDER BY date DESC LIMIT 1)"""


def test_frame(spark, d):
    """The rows to forecast.  They lie after the price table's end, so they take its last price."""
    wanted = roles.test(spark, d)
    daily = M.daily_oil(roles.oil(spark, d))
    last = daily.agg(F.max_by("dcoilwtico", "date")).scalar()
    days = wanted.select("date").distinct().withColumn("dcoilwtico", last)
    return M.tabular_frame(wanted, days, roles.families(spark, d))


@query(
    "q12_tabular_linear_submission",
    f"{TABULAR}, todo AS ({_TEST_X}) SELECT id, round(greatest(list_dot_product(beta, x), 0), 2) AS sales FROM todo, model",
)
def q12(spark, d):
    train, _ = models.tabular_split(spark, d)
    return submitted(spark, M.tabular_linear(train).transform(M.assemble(test_frame(spark, d))))


@query("q12_tabular_boosted_submission")
def q12_boosted(spark, d):
    train, _ = models.tabular_split(spark, d)
    return submitted(spark, M.tabular_boosted(train).transform(test_frame(spark, d)))


def submitted(spark, scored):
    """Write the forecast as a submission and read the file back."""
    path = new_path(spark, "submission")
    tables.write_submission(scored.select("id", clip_low("predicted").alias("sales")), path)
    schema = tables.StructType([f for f in tables.SCHEMAS["train"] if f.name in ("id", "sales")])
    return round_all(spark.read.schema(schema).option("header", True).csv(path), 2, "sales")
