"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfcast.operators import joins as J
from shelfcast.operators.forecast import daily_oil, forecast_to_ids
from shelfcast.operators.reshape import dummies_by
from shelfcast.operators.windows import lag, lead
from shelfcast.plans.registry import exact_mean, query, round_all, spine_sql
from shelfcast.sources import roles

# Daily prices: every day, gaps and zeros missing, interpolated to both ends.
DAILY_OIL = f"""oil_days AS (SELECT s.date, nullif(coalesce(sum(o.dcoilwtico), 0), 0) AS v, row_number() OVER (ORDER BY s.date) AS t
    FROM {spine_sql('oil')} s LEFT JOIN oil o ON s.date = o.date GROUP BY s.date),
oil_known AS (SELECT *, CASE WHEN v IS NOT NULL THEN t END AS kt FROM oil_days),
oil_ends AS (SELECT date, v, t,
        last_value(v IGNORE NULLS) OVER w AS pv, last_value(kt IGNORE NULLS) OVER w AS pt,
        first_value(v IGNORE NULLS) OVER u AS nv, first_value(kt IGNORE NULLS) OVER u AS nt
    FROM oil_known WINDOW w AS (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                          u AS (ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
daily_oil AS (SELECT date, coalesce(v, CASE WHEN pt IS NOT NULL AND nt IS NOT NULL
        THEN pv + (nv - pv) * ((t - pt) / CAST(nt - pt AS DOUBLE)) ELSE coalesce(pv, nv) END) AS dcoilwtico FROM oil_ends)"""


@query("c1_inner_fanout", "SELECT s.id, h.type, h.description FROM sales s JOIN holidays_events h ON s.date = h.date")
def c1(spark, d):
    return J.join_calendar(roles.sales(spark, d), roles.holidays_events(spark)).select("id", "type", "description")


@query("c1_inner_stores", "SELECT s.id, t.city, t.type FROM sales s JOIN stores t ON s.store_nbr = t.store_nbr")
def c1_stores(spark, d):
    return J.merge(roles.sales(spark, d), roles.stores(spark, d), "store_nbr").select("id", "city", "type")


@query(
    "c1_inner_daily_oil",
    f"{DAILY_OIL} SELECT s.id, o.dcoilwtico FROM sales s JOIN daily_oil o ON s.date = o.date",
)
def c1_oil(spark, d):
    joined = J.join_calendar(roles.sales(spark, d), daily_oil(roles.oil(spark, d)))
    return joined.select("id", "dcoilwtico")


@query("c2_inner_two_keys", "SELECT s.id, t.transactions FROM sales s JOIN transactions t USING (date, store_nbr)")
def c2(spark, d):
    out = J.merge(roles.sales(spark, d), roles.transactions(spark, d), ["date", "store_nbr"])
    return out.select("id", "transactions")


@query(
    "c3_left_one_key",
    "SELECT s.id, o.dcoilwtico FROM sales s LEFT JOIN oil o ON s.date = o.date",
)
def c3(spark, d):
    return J.join_calendar(roles.sales(spark, d), roles.oil(spark, d), "left").select("id", "dcoilwtico")


@query(
    "c4_left_two_keys",
    "SELECT s.id, CAST(t.transactions AS DOUBLE) AS transactions FROM sales s LEFT JOIN transactions t USING (date, store_nbr)",
)
def c4(spark, d):
    out = J.merge(roles.sales(spark, d), roles.transactions(spark, d), ["date", "store_nbr"], "left")
    return out.select("id", F.col("transactions").cast("double").alias("transactions"))


@query(
    "c5_dimension_first",
    """SELECT t.store_nbr, t.city, count(s.id) AS n, round(sum(s.sales), 2) AS sales
    FROM stores t LEFT JOIN sales s ON t.store_nbr = s.store_nbr GROUP BY 1, 2""",
)
def c5(spark, d):
    out = J.merge(roles.stores(spark, d), roles.sales(spark, d), "store_nbr", "left")
    return out.groupBy("store_nbr", "city").agg(F.count("id").alias("n"), F.round(F.sum("sales"), 2).alias("sales"))


@query(
    "c6_natural_join",
    """SELECT date, store_nbr, round(sum(sales), 2) AS sales, CAST(any_value(transactions) AS DOUBLE) AS transactions
    FROM sales LEFT JOIN transactions USING (date, store_nbr) GROUP BY 1, 2""",
)
def c6(spark, d):
    daily = roles.sales(spark, d).groupBy("date", "store_nbr").agg(F.round(F.sum("sales"), 2).alias("sales"))
    out = J.natural_join(daily, roles.transactions(spark, d))
    return out.select("date", "store_nbr", "sales", F.col("transactions").cast("double").alias("transactions"))


@query(
    "c7_name_clash",
    """SELECT s.id, h.type AS type_x, t.type AS type_y FROM sales s JOIN holidays_events h ON s.date = h.date
    JOIN stores t ON s.store_nbr = t.store_nbr""",
)
def c7(spark, d):
    held = J.join_calendar(roles.sales(spark, d), roles.holidays_events(spark))
    return J.merge(held, roles.stores(spark, d), "store_nbr").select("id", "type_x", "type_y")


HOLIDAY_NAMES = ["Labour Day", "New Year", "Regional day", "Year end", "Year end bridge"]


@query(
    "c8_dummies_after_left_join",
    """SELECT s.date, round(sum(s.sales), 2) AS sales,
    coalesce(max(CASE WHEN h.description = 'Year end' THEN 1.0 ELSE 0.0 END), 0.0)::DOUBLE AS hol_year_end,
    coalesce(max(CASE WHEN h.description = 'Year end bridge' THEN 1.0 ELSE 0.0 END), 0.0)::DOUBLE AS hol_bridge
    FROM (SELECT date, sum(sales) AS sales FROM sales GROUP BY 1) s LEFT JOIN
    (SELECT DISTINCT date, description FROM holidays_events) h ON s.date = h.date
    GROUP BY s.date HAVING true""".replace("round(sum(s.sales), 2)", "round(any_value(s.sales), 2)"),
)
def c8(spark, d):
    daily = roles.sales(spark, d).groupBy("date").agg(F.round(F.sum("sales"), 2).alias("sales"))
    flags = dummies_by(roles.holidays_events(spark), "date", "description", HOLIDAY_NAMES, "hol")
    out = J.fill_after_join(daily, flags)
    return out.select(
        "date", "sales", F.col("hol_Year end").alias("hol_year_end"), F.col("hol_Year end bridge").alias("hol_bridge")
    )


@query(
    "c9_align",
    """SELECT date, round(sales, 2) AS sales, round(lag_1, 2) AS lag_1 FROM (
    SELECT date, sales, lag(sales) OVER (ORDER BY date) AS lag_1 FROM (SELECT date, sum(sales) AS sales FROM sales GROUP BY 1))
    WHERE lag_1 IS NOT NULL""",
)
def c9(spark, d):
    daily = roles.sales(spark, d).groupBy("date").agg(F.sum("sales").alias("sales"))
    features = lag(daily, "date", "sales", 1, out="lag_1").select("date", "lag_1").dropna()
    return round_all(J.align(daily, features), 2, "sales", "lag_1")


@query(
    "c10_concat_on_date",
    """SELECT coalesce(a.date, b.date) AS date, a.n AS shipped, b.n AS ordered
    FROM (SELECT date, CAST(count(*) AS DOUBLE) AS n FROM sales GROUP BY 1) a
    FULL JOIN (SELECT date, CAST(sum(transactions) AS DOUBLE) AS n FROM transactions GROUP BY 1) b ON a.date = b.date""",
)
def c10(spark, d):
    shipped = roles.sales(spark, d).groupBy("date").agg(F.count(F.lit(1)).cast("double").alias("shipped"))
    ordered = roles.transactions(spark, d).groupBy("date").agg(F.sum("transactions").cast("double").alias("ordered"))
    return J.concat_by_key([shipped, ordered])


@query(
    "c10_concat_one_window",
    """SELECT date, lag(p) OVER w AS promo_lag_1, p AS promo, lead(p) OVER w AS promo_lead_1
    FROM (SELECT date, CAST(sum(onpromotion) AS DOUBLE) AS p FROM sales GROUP BY 1) WINDOW w AS (ORDER BY date)""",
)
def c10_window(spark, d):
    daily = roles.sales(spark, d).groupBy("date").agg(F.sum("onpromotion").cast("double").alias("promo"))
    return lead(lag(daily, "date", "promo"), "date", "promo")


@query(
    "c11_forecast_to_ids",
    """SELECT t.id, m.sales FROM
    (SELECT store_nbr, family, exact_mean(sales) AS sales FROM panel_sales GROUP BY 1, 2) m JOIN panel_test t USING (store_nbr, family)""",
)
def c11(spark, d):
    """A plain forecast, the series' mean on each coming day, put to the ids of the test table."""
    fact = roles.panel_sales(spark, d)
    last = fact.agg(F.max("date")).scalar()
    means = fact.groupBy("store_nbr", "family").agg(exact_mean("sales").alias("sales"))
    ahead = means.withColumn("date", F.explode(F.sequence(F.date_add(last, 1), F.date_add(last, roles.HORIZON))))
    return forecast_to_ids(ahead, roles.panel_test(spark, d))


@query(
    "c12_star_left",
    """SELECT s.id, h.type AS type_x, t.type AS type_y, t.cluster, o.dcoilwtico,
    CAST(x.transactions AS DOUBLE) AS transactions
    FROM sales s LEFT JOIN holidays_events h ON s.date = h.date LEFT JOIN oil o ON s.date = o.date
    LEFT JOIN stores t ON s.store_nbr = t.store_nbr
    LEFT JOIN transactions x ON s.date = x.date AND s.store_nbr = x.store_nbr""",
)
def c12_left(spark, d):
    return J.star_left(
        roles.sales(spark, d), roles.holidays_events(spark), roles.oil(spark, d), roles.stores(spark, d), roles.transactions(spark, d)
    ).select("id", "type_x", "type_y", "cluster", "dcoilwtico", F.col("transactions").cast("double").alias("transactions"))


@query(
    "c12_star_inner",
    """SELECT s.id, h.type AS type_x, t.type AS type_y, x.transactions
    FROM sales s JOIN holidays_events h ON s.date = h.date JOIN stores t ON s.store_nbr = t.store_nbr
    JOIN transactions x ON s.date = x.date AND s.store_nbr = x.store_nbr""",
)
def c12_inner(spark, d):
    out = J.star_inner(
        roles.sales(spark, d), roles.holidays_events(spark), roles.stores(spark, d), roles.transactions(spark, d)
    )
    return out.select("id", "type_x", "type_y", "transactions")


@query(
    "c13_null_keys_match",
    """SELECT a.k, a.n AS n_sales, b.n AS n_days FROM
    (SELECT h.type AS k, count(*) AS n FROM sales s LEFT JOIN holidays_events h ON s.date = h.date GROUP BY 1) a JOIN
    (SELECT h.type AS k, count(DISTINCT s.date) AS n FROM sales s LEFT JOIN holidays_events h ON s.date = h.date GROUP BY 1) b
    ON a.k IS NOT DISTINCT FROM b.k""",
)
def c13(spark, d):
    held = J.join_calendar(roles.sales(spark, d), roles.holidays_events(spark), "left").withColumnRenamed("type", "k")
    sold = held.groupBy("k").agg(F.count(F.lit(1)).alias("n_sales"))
    days = held.groupBy("k").agg(F.count_distinct("date").alias("n_days"))
    return J.merge(sold, days, "k", null_safe=True)
