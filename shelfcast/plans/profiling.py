"""Aggregates, profiles and distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfcast.functions import calendar as cal
from shelfcast.operators import profile as P
from shelfcast.operators import stats as S
from shelfcast.operators.joins import join_calendar, merge, sales_on_dates
from shelfcast.operators.quantiles import median, mode, quantiles
from shelfcast.plans.basics import _STORE_DAYS, store_days
from shelfcast.plans.registry import doubles, exact, exact_mean, query, round_all
from shelfcast.sources import roles


@query(
    "d1_global_aggregates",
    """SELECT exact_mean(sales) AS mean, round(quantile_cont(sales, 0.5), 6) AS median, min(sales) AS min, max(sales) AS max,
    round(sum(sales), 2) AS sum, count(sales) AS count,
    (SELECT onpromotion FROM sales GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS mode FROM sales""",
)
def d1(spark, d):
    fact = roles.sales(spark, d)
    basic = fact.agg(
        exact_mean("sales").alias("mean"),
        F.min("sales").alias("min"),
        F.max("sales").alias("max"),
        F.round(F.sum("sales"), 2).alias("sum"),
        F.count("sales").alias("count"),
    )
    middle, common = median(fact, "sales").scalar(), mode(fact, "onpromotion").scalar()
    return basic.withColumns({"median": F.round(middle, 6), "mode": common})


@query("d1_median_by_family", "SELECT family, round(quantile_cont(sales, 0.5), 6) AS median FROM sales GROUP BY 1")
def d1_by_family(spark, d):
    return round_all(median(roles.sales(spark, d), "sales", ["family"]), 6, "median")


@query(
    "d1_mode_by_store",
    """SELECT store_nbr, family AS mode FROM (SELECT store_nbr, family, row_number() OVER (PARTITION BY store_nbr
    ORDER BY count(*) DESC, family) AS r FROM sales GROUP BY 1, 2) WHERE r = 1""",
)
def d1_mode(spark, d):
    return mode(roles.sales(spark, d), "family", by=["store_nbr"])


@query(
    "d2_group_one_key",
    "SELECT family, exact_mean(sales) AS mean, round(sum(sales), 2) AS sum, count(*) AS count FROM sales GROUP BY 1",
)
def d2(spark, d):
    return P.group_agg(
        roles.sales(spark, d),
        "family",
        exact_mean("sales").alias("mean"),
        F.round(F.sum("sales"), 2).alias("sum"),
        F.count(F.lit(1)).alias("count"),
    )


@query("d2_mean_per_date", "SELECT date, exact_mean(sales) AS sales FROM sales GROUP BY 1")
def d2_date(spark, d):
    return P.group_agg(roles.sales(spark, d), "date", exact_mean("sales").alias("sales"))


@query("d2_null_keys_dropped", "SELECT h.type, count(*) AS n FROM sales s JOIN holidays_events h ON s.date = h.date GROUP BY 1")
def d2_null(spark, d):
    held = join_calendar(roles.sales(spark, d), roles.holidays_events(spark), "left")
    return P.group_agg(held, "type", F.count(F.lit(1)).alias("n"))


@query(
    "d3_group_many_keys",
    """SELECT year(date) AS year, store_nbr, family, round(sum(sales), 2) AS sales,
    CAST(sum(onpromotion) AS BIGINT) AS onpromotion FROM sales GROUP BY ALL""",
)
def d3(spark, d):
    keyed = roles.sales(spark, d).withColumn("year", F.year("date").cast("bigint"))
    return P.group_agg(
        keyed, ["year", "store_nbr", "family"], F.round(F.sum("sales"), 2).alias("sales"), F.sum("onpromotion").alias("onpromotion")
    )


@query(
    "d4_mixed_aggregates",
    """SELECT family, CAST(sum(onpromotion) AS BIGINT) AS onpromotion, exact_mean(sales) AS sales
    FROM sales JOIN holidays_events USING (date) GROUP BY 1""",
)
def d4(spark, d):
    held = join_calendar(roles.sales(spark, d), roles.holidays_events(spark))
    return P.group_agg(held, "family", F.sum("onpromotion").alias("onpromotion"), exact_mean("sales").alias("sales"))


@query(
    "d5_filter_group_sort",
    """SELECT family, exact_mean(sales) AS sales, CAST(sum(onpromotion) AS BIGINT) AS onpromotion
    FROM sales s JOIN holidays_events h USING (date) WHERE h.type = 'Bridge' GROUP BY 1 ORDER BY 2 DESC, 1""",
)
def d5(spark, d):
    bridge = roles.holidays_events(spark).filter(F.col("type") == "Bridge")
    held = join_calendar(roles.sales(spark, d), bridge)
    out = P.group_agg(held, "family", exact_mean("sales").alias("sales"), F.sum("onpromotion").alias("onpromotion"))
    return out.orderBy(F.desc("sales"), F.asc("family"))


_PIVOT = ", ".join(f'exact_mean(CASE WHEN month(date) = {m} THEN sales END) AS "{m}"' for m in range(1, 13))


@query("d6_pivot_mean", f"SELECT dayname(date) AS day_name, {_PIVOT} FROM sales GROUP BY 1")
def d6(spark, d):
    fact = exact(roles.sales(spark, d), "sales")
    dated = fact.select(cal.weekday_name("date").alias("day_name"), F.month("date").alias("month"), "sales")
    out = P.pivot_mean(dated, "day_name", "month", "sales", range(1, 13), cal.WEEKDAYS)
    return doubles(out, *[str(m) for m in range(1, 13)])


@query("d7_value_counts", "SELECT type, count(*) AS count FROM sales JOIN holidays_events USING (date) GROUP BY 1")
def d7(spark, d):
    return P.value_counts(join_calendar(roles.sales(spark, d), roles.holidays_events(spark), "left"), "type")


@query(
    "d8_distinct_counts",
    "SELECT count(DISTINCT family) AS families, count(DISTINCT store_nbr) AS stores, count(DISTINCT date) AS days FROM sales",
)
def d8(spark, d):
    return roles.sales(spark, d).agg(
        F.count_distinct("family").alias("families"),
        F.count_distinct("store_nbr").alias("stores"),
        F.count_distinct("date").alias("days"),
    )


@query("d8_distinct_values", "SELECT DISTINCT s.family, t.type FROM sales s JOIN stores t USING (store_nbr)")
def d8_values(spark, d):
    return merge(roles.sales(spark, d), roles.stores(spark, d), "store_nbr").select("family", "type").distinct()


@query(
    "d9_share_of_zero",
    f"{_STORE_DAYS} SELECT round(100.0 * avg(CASE WHEN sales = 0 THEN 1.0 ELSE 0.0 END), 6) AS percent FROM store_days",
)
def d9(spark, d):
    return round_all(P.share(store_days(spark, d), F.col("sales") == 0), 6, "percent")


_WIDE = """wide AS (SELECT s.date, s.family, h.type, o.dcoilwtico, t.transactions
    FROM sales s LEFT JOIN holidays_events h ON s.date = h.date LEFT JOIN oil o ON s.date = o.date
    LEFT JOIN transactions t ON s.date = t.date AND s.store_nbr = t.store_nbr)"""
_WIDE_COLS = ["date", "family", "type", "dcoilwtico", "transactions"]


def _wide(spark, d):
    held = join_calendar(roles.sales(spark, d), roles.holidays_events(spark), "left")
    priced = join_calendar(held, roles.oil(spark, d), "left")
    return merge(priced, roles.transactions(spark, d), ["date", "store_nbr"], "left").select(*_WIDE_COLS)


@query(
    "d10_null_report",
    f"{_WIDE} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls, round(100.0 * (count(*) - count({c})) / count(*), 6) AS percent FROM wide"
        for c in _WIDE_COLS
    ),
)
def d10(spark, d):
    return round_all(P.null_report(_wide(spark, d)), 6, "percent")


_SUMMARY_TYPES = {"date": "date", "family": "string", "type": "string", "dcoilwtico": "double", "transactions": "bigint"}


@query(
    "d11_column_summary",
    f"{_WIDE}, dup AS (SELECT CAST(sum(n - 1) AS BIGINT) AS duplicates FROM (SELECT count(*) AS n FROM wide GROUP BY date, family, type, dcoilwtico, transactions)) "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{k}' AS dtype, count({c}) AS instances, count(DISTINCT {c}) AS "unique",
        count(*) - count({c}) AS sum_null, (SELECT duplicates FROM dup) AS duplicates FROM wide"""
        for c, k in _SUMMARY_TYPES.items()
    ),
)
def d11(spark, d):
    return P.column_summary(_wide(spark, d))


@query(
    "d12_duplicate_rows",
    f"{_WIDE} SELECT CAST(sum(n - 1) AS BIGINT) AS duplicates FROM (SELECT count(*) AS n FROM wide GROUP BY date, family, type, transactions)",
)
def d12(spark, d):
    return P.duplicate_rows(_wide(spark, d).select("date", "family", "type", "transactions"))


@query(
    "d13_describe",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 4) AS std,
        CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 6) AS q25,
        round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS q50, round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 6) AS q75 FROM sales"""
        for c in ("sales", "onpromotion")
    ),
)
def d13(spark, d):
    out = P.describe(roles.sales(spark, d), ["sales", "onpromotion"])
    return round_all(round_all(out, 6, "mean", "q25", "q50", "q75"), 4, "std")


@query(
    "d14_shape_and_types",
    f"{_WIDE} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{k}' AS dtype, count(*) AS rows, count({c}) AS non_null FROM wide"
        for c, k in _SUMMARY_TYPES.items()
    ),
)
def d14(spark, d):
    return P.non_null_counts(_wide(spark, d))


_CORR_COLS = ["sales", "onpromotion", "transactions", "dcoilwtico"]


@query(
    "d15_corr_matrix",
    """merged AS (SELECT s.sales, CAST(s.onpromotion AS DOUBLE) AS onpromotion, CAST(t.transactions AS DOUBLE) AS transactions, o.dcoilwtico
    FROM sales s LEFT JOIN oil o ON s.date = o.date LEFT JOIN transactions t ON s.date = t.date AND s.store_nbr = t.store_nbr) """
    + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM merged" for a in _CORR_COLS for b in _CORR_COLS
    ),
)
def d15(spark, d):
    priced = join_calendar(roles.sales(spark, d), roles.oil(spark, d), "left")
    merged = merge(priced, roles.transactions(spark, d), ["date", "store_nbr"], "left")
    return round_all(P.corr_matrix(merged, _CORR_COLS), 6, "corr")


@query(
    "d16_corr_spearman",
    """ranked AS (SELECT rank() OVER (ORDER BY sales) + (count(*) OVER (PARTITION BY sales) - 1) / 2.0 AS x,
    rank() OVER (ORDER BY onpromotion) + (count(*) OVER (PARTITION BY onpromotion) - 1) / 2.0 AS y FROM sales)
    SELECT round(corr(x, y), 6) AS corr FROM ranked""",
)
def d16(spark, d):
    return round_all(P.corr_spearman(roles.sales(spark, d), "sales", "onpromotion"), 6, "corr")


@query(
    "d17_category_histogram",
    "SELECT t.type, s.family, count(*) AS count FROM sales s JOIN stores t USING (store_nbr) GROUP BY 1, 2",
)
def d17(spark, d):
    held = merge(roles.sales(spark, d), roles.stores(spark, d), "store_nbr")
    return held.groupBy("type", "family").agg(F.count(F.lit(1)).alias("count"))


@query(
    "d18_histogram",
    """span AS (SELECT min(sales) AS lo, (max(sales) - min(sales)) / 50 AS w FROM sales),
    counts AS (SELECT least(floor((sales - lo) / w) + 1, 50)::BIGINT AS bin, count(*) AS n FROM sales, span GROUP BY 1)
    SELECT b.bin, round(lo + w * (b.bin - 1), 4) AS lo, round(lo + w * b.bin, 4) AS hi, coalesce(n, 0) AS n
    FROM range(1, 51) b(bin) LEFT JOIN counts USING (bin), span""",
)
def d18(spark, d):
    return round_all(P.histogram(roles.sales(spark, d), "sales", 50), 4, "lo", "hi")


_BOX = """box AS (SELECT {k}quantile_cont(sales, 0.25) AS q1, quantile_cont(sales, 0.5) AS median, quantile_cont(sales, 0.75) AS q3
    FROM sales {g}),
    marked AS (SELECT s.*, q1, median, q3, sales BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM sales s {j})
    SELECT {k}round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, min(sales) FILTER (inside) AS low,
    max(sales) FILTER (inside) AS high, count(*) FILTER (NOT inside) AS outliers, exact_mean(sales) AS mean
    FROM marked GROUP BY ALL"""


@query("d19_box_stats", _BOX.format(k="", g="", j=", box"))
def d19(spark, d):
    out = P.box_stats(exact(roles.sales(spark, d), "sales"), "sales")
    return doubles(round_all(out, 6, "q1", "median", "q3"), "low", "high", "mean")


@query("d19_box_stats_by_family", _BOX.format(k="family, ", g="GROUP BY family", j="JOIN box USING (family)"))
def d19_by_family(spark, d):
    out = P.box_stats(exact(roles.sales(spark, d), "sales"), "sales", ["family"])
    return doubles(round_all(out, 6, "q1", "median", "q3"), "low", "high", "mean")


@query(
    "d20_ols_line",
    """SELECT round(regr_slope(sales, x), 6) AS slope, round(regr_intercept(sales, x), 2) AS intercept,
    round(regr_r2(sales, x), 6) AS r2, regr_count(sales, x)::BIGINT AS n FROM (SELECT date, CAST(onpromotion AS DOUBLE) AS x, sales FROM sales)""",
)
def d20(spark, d):
    out = S.ols_line(roles.sales(spark, d), "onpromotion", "sales")
    return round_all(round_all(out, 6, "slope", "r2"), 2, "intercept")


@query(
    "d20_ols_line_on_dates_by_family",
    """SELECT family, round(regr_slope(sales, x), 6) AS slope, round(regr_intercept(sales, x), 2) AS intercept,
    round(regr_r2(sales, x), 6) AS r2, regr_count(sales, x)::BIGINT AS n
    FROM (SELECT family, CAST(datediff('day', DATE '1970-01-01', date) AS DOUBLE) AS x, sum(sales) AS sales FROM sales GROUP BY 1, 2) GROUP BY 1""",
)
def d20_by_family(spark, d):
    daily = roles.sales(spark, d).groupBy("family", "date").agg(F.sum("sales").alias("sales"))
    out = S.ols_line(daily, "date", "sales", ["family"])
    return round_all(round_all(out, 6, "slope", "r2"), 2, "intercept")


@query(
    "d21_kernel_density",
    """v AS (SELECT dcoilwtico AS v FROM oil WHERE dcoilwtico IS NOT NULL),
    s AS (SELECT count(*) AS n, stddev_samp(v) * pow(count(*), -0.2) AS h, min(v) AS mn, max(v) AS mx FROM v),
    grid AS (SELECT i, mn - 3 * h + (mx - mn + 6 * h) / 199 * i AS x, n, h FROM s, range(200) g(i))
    SELECT i, round(x, 6) AS x, round(sum(exp(-0.5 * ((x - v) / h) * ((x - v) / h))) / any_value(n * h * sqrt(2 * pi())), 9) AS density
    FROM grid, v GROUP BY i, x""",
)
def d21(spark, d):
    return round_all(round_all(S.kde(roles.oil(spark, d), "dcoilwtico"), 6, "x"), 9, "density")


@query("d22_mean_with_band")
def d22(spark, d):
    """Bootstrap draws differ between engines; tests check the band against theory."""
    dated = roles.sales(spark, d).select("sales", F.month("date").alias("month"), F.year("date").alias("year"))
    return S.mean_ci(dated, "month", "sales", ["year"])


@query(
    "d23_two_level_rollup",
    """store_day AS (SELECT date, store_nbr, sum(sales) AS sales FROM sales GROUP BY 1, 2),
    moved AS (SELECT date, round(sum(sales), 2) AS sales FROM store_day
              WHERE date IN (SELECT date FROM holidays_events WHERE type = 'Transfer') GROUP BY 1)
    SELECT date, sales, (SELECT round(avg(t), 4) FROM (SELECT sum(sales) AS t FROM store_day GROUP BY date)) AS mean_day FROM moved""",
)
def d23(spark, d):
    per_store = roles.sales(spark, d).groupBy("date", "store_nbr").agg(F.sum("sales").alias("sales"))
    per_day = per_store.groupBy("date").agg(F.sum("sales").alias("sales"))
    moved = roles.holidays_events(spark).filter(F.col("type") == "Transfer")
    chosen = sales_on_dates(per_day, moved).select("date", F.round("sales", 2).alias("sales"))
    return chosen.withColumn("mean_day", F.round(per_day.agg(F.avg("sales")).scalar(), 4))


@query(
    "d24_scatter_frame",
    "SELECT s.onpromotion AS x, s.sales AS y, h.type AS hue FROM sales s JOIN holidays_events h ON s.date = h.date",
)
def d24(spark, d):
    held = join_calendar(roles.sales(spark, d), roles.holidays_events(spark))
    return held.select(F.col("onpromotion").alias("x"), F.col("sales").alias("y"), F.col("type").alias("hue"))


@query(
    "d13_quantiles_of_prices",
    "SELECT "
    + ", ".join(f"round(quantile_cont(l_extendedprice, {p}), 6) AS p{int(p * 100)}" for p in (0.05, 0.25, 0.5, 0.75, 0.95))
    + " FROM lineitem",
)
def d13_quantiles(spark, d):
    probs = {f"p{int(p * 100)}": p for p in (0.05, 0.25, 0.5, 0.75, 0.95)}
    return round_all(quantiles(roles.table(spark, d, "lineitem"), "l_extendedprice", probs), 6, *probs)
