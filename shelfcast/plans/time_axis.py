"""Calendar buckets, windows and serial statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfcast.functions import calendar as cal
from shelfcast.functions.scalars import null_sentinel
from shelfcast.operators import resample as E
from shelfcast.operators import stats as S
from shelfcast.operators import windows as W
from shelfcast.operators.joins import join_calendar
from shelfcast.operators.reshape import encode_first_seen
from shelfcast.plans.joining import DAILY_OIL
from shelfcast.plans.registry import doubles, exact, query, round_all, spine_sql
from shelfcast.sources import roles

_SPINE = spine_sql("sales")


def daily_total(spark, d, *by):
    """Total sales and promotions per day (and key), one row per observed day."""
    out = roles.sales(spark, d).groupBy(*by, "date").agg(
        F.round(F.sum("sales"), 2).alias("sales"), F.sum("onpromotion").cast("double").alias("onpromotion")
    )
    return out


DAILY = """daily AS (SELECT date, round(sum(sales), 2) AS sales, CAST(sum(onpromotion) AS DOUBLE) AS onpromotion
    FROM sales GROUP BY 1)"""
DAILY_FAMILY = """daily AS (SELECT family, date, round(sum(sales), 2) AS sales, CAST(sum(onpromotion) AS DOUBLE) AS onpromotion
    FROM sales GROUP BY 1, 2)"""


@query(
    "e1_resample_daily_sum",
    f"""SELECT s.date, round(coalesce(sum(x.sales), 0), 2) AS sales, CAST(coalesce(sum(x.onpromotion), 0) AS BIGINT) AS onpromotion
    FROM {_SPINE} s LEFT JOIN sales x ON s.date = x.date GROUP BY 1""",
)
def e1(spark, d):
    return round_all(E.resample(roles.sales(spark, d), "D", {"sales": "sum", "onpromotion": "sum"}), 2, "sales")


@query(
    "e2_resample_daily_mean",
    f"""SELECT s.date, exact_mean(x.sales) AS sales FROM {_SPINE} s LEFT JOIN sales x ON s.date = x.date GROUP BY 1""",
)
def e2(spark, d):
    return doubles(E.resample(exact(roles.sales(spark, d), "sales"), "D", {"sales": "mean"}), "sales")


@query(
    "e3_resample_weekly_mean",
    """SELECT CAST(date_trunc('week', date) AS DATE) + 6 AS date, exact_mean(sales) AS sales FROM sales GROUP BY 1""",
)
def e3(spark, d):
    return doubles(E.resample(exact(roles.sales(spark, d), "sales"), "W", {"sales": "mean"}), "sales")


@query(
    "e4_resample_monthly",
    """SELECT last_day(date) AS date, round(sum(sales), 2) AS sales, exact_mean(onpromotion) AS onpromotion FROM sales GROUP BY 1""",
)
def e4(spark, d):
    out = E.resample(exact(roles.sales(spark, d), "onpromotion"), "M", {"sales": "sum", "onpromotion": "mean"})
    return doubles(round_all(out, 2, "sales"), "onpromotion")


@query(
    "e5_resample_daily_by_store",
    f"""SELECT s.store_nbr, s.date, CAST(coalesce(t.transactions, 0) AS BIGINT) AS transactions
    FROM {spine_sql('transactions', 'store_nbr')} s LEFT JOIN transactions t ON s.store_nbr = t.store_nbr AND s.date = t.date""",
)
def e5(spark, d):
    return E.resample(roles.transactions(spark, d), "D", {"transactions": "sum"}, by=["store_nbr"])


@query(
    "e6_grouped_by_calendar",
    """SELECT last_day(date) AS date, exact_mean(sales) AS sales FROM sales GROUP BY 1""",
)
def e6(spark, d):
    return doubles(E.grouped(exact(roles.sales(spark, d), "sales"), "date", "M", "sales"), "sales")


@query(
    "e6_events_by_day",
    f"""ev AS (SELECT CAST(ts AS DATE) AS date, event_type, value FROM events)
    SELECT s.event_type, s.date, round(coalesce(sum(value), 0), 2) AS value FROM {spine_sql('ev', 'event_type')} s
    LEFT JOIN ev USING (event_type, date) GROUP BY 1, 2""",
)
def e6_events(spark, d):
    dated = roles.table(spark, d, "events").select(F.col("ts").cast("date").alias("date"), "event_type", "value")
    return round_all(E.resample(dated, "D", {"value": "sum"}, by=["event_type"]), 2, "value")


@query("e7_date_spine", f"SELECT s.date, count(x.id) AS n FROM {_SPINE} s LEFT JOIN sales x ON s.date = x.date GROUP BY 1")
def e7(spark, d):
    fact = roles.sales(spark, d)
    lo, hi = fact.agg(F.min("date")).scalar(), fact.agg(F.max("date")).scalar()
    spine = spark.range(1).select(F.explode(F.sequence(lo, hi)).alias("date"))
    counts = fact.groupBy("date").agg(F.count("id").alias("n"))
    return spine.join(counts, "date", "left").na.fill(0, ["n"])


@query(
    "e8_year_month_overlay",
    """SELECT last_day(date) AS date, exact_mean(sales) AS sales, year(last_day(date)) AS year,
    month(last_day(date)) AS month_nbr, monthname(last_day(date)) AS month FROM sales GROUP BY 1""",
)
def e8(spark, d):
    return doubles(E.overlay_by_year(exact(roles.sales(spark, d), "sales"), "sales"), "sales")


@query(
    "e9_weekday_profile",
    """SELECT year(date) AS year, isodow(date) AS dayofweek, exact_mean(transactions) AS transactions FROM transactions GROUP BY 1, 2""",
)
def e9(spark, d):
    return doubles(E.weekday_profile(exact(roles.transactions(spark, d), "transactions"), "transactions"), "transactions")


def _ma_sql(n, need, rel="daily", part=""):
    lo, hi = n // 2, (n - 1) // 2
    over = f"OVER ({part}ORDER BY date ROWS BETWEEN {lo} PRECEDING AND {hi} FOLLOWING)"
    total, rows = f"sum(CAST(round(sales * 100) AS BIGINT)) {over}", f"count(sales) {over}"
    return f"CASE WHEN {rows} >= {need} THEN CAST((20000 * {total} + {rows}) // (2 * {rows}) AS DOUBLE) / 1e6 END"


@query(
    "w1_moving_averages",
    f"""{DAILY} SELECT date, {_ma_sql(7, 4)} AS ma_7, {_ma_sql(7, 7)} AS ma_7_full, {_ma_sql(12, 6)} AS ma_12,
    {_ma_sql(365, 183)} AS ma_365 FROM daily""",
)
def w1(spark, d):
    out = exact(daily_total(spark, d).select("date", "sales"), "sales")
    for n, need, name in ((7, 4, "ma_7"), (7, None, "ma_7_full"), (12, 6, "ma_12"), (365, 183, "ma_365")):
        out = W.moving_avg(out, "date", "sales", n, need, out=name)
    return doubles(out.drop("sales"), "ma_7", "ma_7_full", "ma_12", "ma_365")


@query(
    "w1_moving_average_by_family",
    f"{DAILY_FAMILY} SELECT family, date, {_ma_sql(12, 6, part='PARTITION BY family ')} AS ma_12 FROM daily",
)
def w1_by_family(spark, d):
    out = W.moving_avg(exact(daily_total(spark, d, "family"), "sales"), "date", "sales", 12, 6, ["family"], "ma_12")
    return doubles(out.select("family", "date", "ma_12"), "ma_12")


@query(
    "w2_lag",
    f"{DAILY_FAMILY} SELECT family, date, lag(sales, 1) OVER (PARTITION BY family ORDER BY date) AS lag_1 FROM daily",
)
def w2(spark, d):
    out = W.lag(daily_total(spark, d, "family"), "date", "sales", 1, ["family"], "lag_1")
    return out.select("family", "date", "lag_1")


@query(
    "w3_lead",
    f"{DAILY_FAMILY} SELECT family, date, lead(sales, 2) OVER (PARTITION BY family ORDER BY date) AS lead_2 FROM daily",
)
def w3(spark, d):
    out = W.lead(daily_total(spark, d, "family"), "date", "sales", 2, ["family"], "lead_2")
    return out.select("family", "date", "lead_2")


@query(
    "w4_lag_and_lead_sets",
    f"""{DAILY} SELECT date, lag(sales, 1) OVER w AS y_lag_1, lag(sales, 2) OVER w AS y_lag_2, lag(sales, 3) OVER w AS y_lag_3,
    lead(sales, 1) OVER w AS y_lead_1, lead(sales, 2) OVER w AS y_lead_2 FROM daily WINDOW w AS (ORDER BY date)""",
)
def w4(spark, d):
    out = W.make_leads(W.make_lags(daily_total(spark, d), "date", "sales", 3), "date", "sales", 2)
    return out.drop("sales", "onpromotion")


@query("w5_time_step", "SELECT id, row_number() OVER (ORDER BY id) - 1 AS time FROM sales")
def w5(spark, d):
    return W.time_step(roles.sales(spark, d).select("id"), "id")


@query("w5_time_step_by_key", f"{DAILY_FAMILY} SELECT family, date, row_number() OVER (PARTITION BY family ORDER BY date) - 1 AS time FROM daily")
def w5_by_key(spark, d):
    return W.time_step(daily_total(spark, d, "family"), "date", ["family"]).select("family", "date", "time")


def _fill_sql(rel, val, order, edge):
    """Linear interpolation by position as SQL."""
    return f"""numbered AS (SELECT *, {val} AS v, row_number() OVER (ORDER BY {order}) AS t FROM {rel}),
ends AS (SELECT *, last_value(v IGNORE NULLS) OVER w AS pv, last_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER w AS pt,
        first_value(v IGNORE NULLS) OVER u AS nv, first_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER u AS nt
    FROM numbered WINDOW w AS (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                         u AS (ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
filled AS (SELECT *, coalesce(v, CASE WHEN pt IS NOT NULL AND nt IS NOT NULL
        THEN pv + (nv - pv) * ((t - pt) / CAST(nt - pt AS DOUBLE)) ELSE {edge} END) AS f FROM ends)"""


@query(
    "w6_interpolate",
    f"""priced AS (SELECT s.id, nullif(o.dcoilwtico, 0) AS p FROM sales s LEFT JOIN oil o ON s.date = o.date),
    {_fill_sql('priced', 'p', 'id', 'pv')} SELECT id, f AS dcoilwtico FROM filled""",
)
def w6(spark, d):
    """Over the merged table in id order, row by row."""
    joined = join_calendar(roles.sales(spark, d).select("id", "date"), roles.oil(spark, d), "left")
    priced = joined.select("id", null_sentinel("dcoilwtico").alias("dcoilwtico"))
    return W.interpolate(priced, "id", "dcoilwtico")


@query(
    "w7_interpolate_both_edges",
    f"{DAILY_OIL} SELECT date, dcoilwtico FROM daily_oil",
)
def w7(spark, d):
    daily = E.resample(roles.oil(spark, d), "D", {"dcoilwtico": "sum"})
    return W.interpolate(daily.withColumn("dcoilwtico", null_sentinel("dcoilwtico", 0.0)), "date", "dcoilwtico", both_edges=True)


@query(
    "w8_fill_leading_by_constant",
    f"""{_fill_sql('oil', 'nullif(dcoilwtico, 0)', 'date', 'pv')} SELECT date, coalesce(f, 93.14) AS dcoilwtico FROM filled""",
)
def w8(spark, d):
    oil = roles.oil(spark, d).withColumn("dcoilwtico", null_sentinel("dcoilwtico", 0.0))
    filled = W.interpolate(oil, "date", "dcoilwtico")
    return filled.withColumn("dcoilwtico", F.coalesce("dcoilwtico", F.lit(93.14)))


@query(
    "w9_zscore",
    """SELECT id, round((sales - avg(sales) OVER ()) / stddev_samp(sales) OVER (), 8) AS z FROM sales""",
)
def w9(spark, d):
    return round_all(W.zscore(roles.sales(spark, d).select("id", "sales"), "sales", out="z").drop("sales"), 8, "z")


@query(
    "w9_zscore_by_family",
    """SELECT id, round((sales - avg(sales) OVER w) / stddev_samp(sales) OVER w, 8) AS z FROM sales WINDOW w AS (PARTITION BY family)""",
)
def w9_by_family(spark, d):
    out = W.zscore(roles.sales(spark, d).select("id", "family", "sales"), "sales", ["family"], "z")
    return round_all(out.select("id", "z"), 8, "z")


def _corr_sql(kind, x, y, n):
    shifted = ", ".join(f"{kind}({x}, {k}) OVER (ORDER BY date) AS s{k}" for k in range(1, n + 1))
    rows = " UNION ALL ".join(f"SELECT {k}::BIGINT AS {kind}, round(corr({y}, s{k}), 6) AS corr FROM moved" for k in range(1, n + 1))
    return f"{DAILY}, moved AS (SELECT *, {shifted} FROM daily) {rows}"


@query("w10_lag_correlation", _corr_sql("lag", "sales", "sales", 8))
def w10(spark, d):
    return round_all(W.lag_corr(daily_total(spark, d), "date", "sales", lags=8), 6, "corr")


@query("w10_lag_correlation_two_series", _corr_sql("lag", "onpromotion", "sales", 3))
def w10_two(spark, d):
    return round_all(W.lag_corr(daily_total(spark, d), "date", "onpromotion", "sales", 3), 6, "corr")


@query("w11_lead_correlation", _corr_sql("lead", "onpromotion", "sales", 3))
def w11(spark, d):
    return round_all(W.lead_corr(daily_total(spark, d), "date", "onpromotion", "sales", 3), 6, "corr")


@query(
    "w12_partial_autocorrelation",
    f"""{DAILY_FAMILY},
    z AS (SELECT family, date, sales - avg(sales) OVER (PARTITION BY family) AS z FROM daily),
    l AS (SELECT family, z, {', '.join(f'lag(z, {k}) OVER (PARTITION BY family ORDER BY date) AS z{k}' for k in range(1, 9))} FROM z),
    r AS (SELECT family, count(*) AS n, [{', '.join(f'sum(z * z{k}) / sum(z * z)' for k in range(1, 9))}] AS r FROM l GROUP BY 1),
    steps(family, n, r, k, phi, a) AS (
        SELECT family, n, r, 1, [r[1]], r[1] FROM r
        UNION ALL
        SELECT family, n, r, k + 1, list_append(list_transform(range(1, k + 1), lambda j: phi[j] - b * phi[k + 1 - j]), b), b FROM (
            SELECT *, (r[k + 1] - list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[k + 1 - j])))
                      / (1 - list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[j]))) AS b FROM steps WHERE k < 8))
    SELECT family, k::BIGINT AS lag, round(a, 6) AS pacf, round(1.96 / sqrt(n), 6) AS band FROM steps""",
)
def w12(spark, d):
    return round_all(S.pacf(daily_total(spark, d, "family"), "date", "sales", 8, ["family"]), 6, "pacf", "band")


@query(
    "w13_first_seen_codes",
    """seen AS (SELECT family, row_number() OVER (ORDER BY min(id)) AS code FROM sales GROUP BY 1)
    SELECT id, code AS family_code FROM sales JOIN seen USING (family)""",
)
def w13(spark, d):
    out = encode_first_seen(roles.sales(spark, d).select("id", "family"), "family", "id")
    return out.select("id", "family_code")


@query(
    "j19_periodogram",
    f"""{DAILY}, t AS (SELECT sales AS y, row_number() OVER (ORDER BY date) - 1 AS t FROM daily),
    line AS (SELECT count(*) AS n, regr_slope(y, t) AS b, regr_intercept(y, t) AS a FROM t),
    e AS (SELECT t, y - a - b * t AS e, n FROM t, line),
    f AS (SELECT k, n, sum(e * cos(2 * pi() * ((k * t) % n) / n)) AS c, sum(e * sin(2 * pi() * ((k * t) % n) / n)) AS s
          FROM e, range(0, (SELECT n // 2 + 1 FROM line)) r(k) GROUP BY ALL)
    SELECT k, round(k * 365.0 / n, 8) AS frequency,
           round((CASE WHEN k = 0 OR 2 * k = n THEN 1 ELSE 2 END) * (c * c + s * s) / (n * n) / 1e6, 6) AS power FROM f""",
)
def j19(spark, d):
    out = S.periodogram(daily_total(spark, d), "date", "sales")
    return round_all(round_all(out.withColumn("power", F.col("power") / 1e6), 6, "power"), 8, "frequency")


@query(
    "j20_seasonal_week_by_weekday",
    """SELECT weekofyear(date) AS period, isodow(date) - 1 AS freq, exact_mean(sales) AS sales
    FROM sales WHERE year(date) = 2000 GROUP BY 1, 2""",
)
def j20(spark, d):
    fact = exact(roles.sales(spark, d), "sales").filter(cal.in_year("date", roles.MODEL_YEAR))
    week, day = F.weekofyear("date").cast("bigint"), cal.weekday("date").cast("bigint")
    return doubles(E.seasonal(fact, "sales", week, day), "sales")


@query(
    "j20_seasonal_year_by_day",
    """SELECT year(date) AS period, dayofyear(date) AS freq, exact_mean(sales) AS sales FROM sales GROUP BY 1, 2""",
)
def j20_year(spark, d):
    year, day = F.year("date").cast("bigint"), F.dayofyear("date").cast("bigint")
    return doubles(E.seasonal(exact(roles.sales(spark, d), "sales"), "sales", year, day), "sales")
