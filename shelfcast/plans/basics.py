"""Sources, projections, predicates, sorts and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfcast.functions import calendar as cal
from shelfcast.functions import scalars as sc
from shelfcast.operators.joins import join_calendar, merge, sales_on_dates
from shelfcast.operators.profile import group_agg, impute
from shelfcast.operators.resample import resample
from shelfcast.plans.registry import exact_mean, query, round_all, spine_sql
from shelfcast.sources import roles, tables
from shelfcast.sources.scratch import new_path, stored


def _as_csv(spark, df, name):
    """Write a role as CSV under a new shared folder and return the folder."""
    folder = new_path(spark, "csv")
    df.write.option("header", True).csv(f"{folder}/{name}.csv")
    return folder


@query(
    "a1_csv_scan",
    """
SELECT 'train' AS name, count(*) AS n, round(sum(sales), 2) AS total FROM sales
UNION ALL SELECT 'stores', count(*), CAST(sum(cluster) AS DOUBLE) FROM stores
UNION ALL SELECT 'oil', count(dcoilwtico), round(sum(dcoilwtico), 2) FROM oil
UNION ALL SELECT 'transactions', count(*), CAST(sum(transactions) AS DOUBLE) FROM transactions
UNION ALL SELECT 'test', count(*), CAST(sum(onpromotion) AS DOUBLE) FROM test
UNION ALL SELECT 'holidays_events', count(*), CAST(sum(CAST(transferred AS INTEGER)) AS DOUBLE) FROM holidays_events""",
)
def a1(spark, d):
    made = {
        "train": (roles.sales(spark, d), "sales"),
        "stores": (roles.stores(spark, d), "cluster"),
        "oil": (roles.oil(spark, d), "dcoilwtico"),
        "transactions": (roles.transactions(spark, d), "transactions"),
        "test": (roles.test(spark, d), "onpromotion"),
        "holidays_events": (roles.holidays_events(spark, d), "transferred"),
    }
    out = None
    for name, (df, col) in made.items():
        read = tables.read_table(spark, _as_csv(spark, df, name), name)
        value = F.col(col).cast("int") if name == "holidays_events" else F.col(col)
        row = read.agg(
            F.count(col).alias("n"), F.round(F.sum(value).cast("double"), 2).alias("total")
        ).select(F.lit(name).alias("name"), "n", "total")
        out = row if out is None else out.unionByName(row)
    return out


@query("a2_typed_csv_scan", "SELECT id, date, CAST(store_nbr AS INTEGER) AS store_nbr, family, onpromotion FROM test")
def a2(spark, d):
    folder = _as_csv(spark, roles.test(spark, d), "test")
    return tables.read_table(spark, folder, "test", tables.SCHEMAS["test"])


@query("a3_parse_date", "SELECT date, count(*) AS n FROM sales GROUP BY date")
def a3(spark, d):
    text = roles.sales(spark, d).select(F.col("date").cast("string").alias("date"))
    return tables.parse_date(text, "date").groupBy("date").agg(F.count(F.lit(1)).alias("n"))


@query("a4_csv_sink", "SELECT id, sales FROM sales")
def a4(spark, d):
    path = new_path(spark, "submission")
    tables.write_submission(roles.sales(spark, d), path)
    schema = tables.StructType([f for f in tables.SCHEMAS["train"] if f.name in ("id", "sales")])
    return spark.read.schema(schema).option("header", True).csv(path)


@query("b1_drop_columns", "SELECT date, store_nbr, family, sales FROM sales")
def b1(spark, d):
    return roles.sales(spark, d).drop("id", "onpromotion")


@query("b2_rename", 'SELECT date, store_nbr AS shop, sum(sales)::DECIMAL(18,2)::DOUBLE AS turnover FROM sales GROUP BY ALL')
def b2(spark, d):
    out = roles.sales(spark, d).groupBy("date", "store_nbr").agg(F.round(F.sum("sales"), 2).alias("sales"))
    return out.withColumnsRenamed({"store_nbr": "shop", "sales": "turnover"})


@query("b3_ordered_projection", "SELECT id, sales FROM sales")
def b3(spark, d):
    return roles.sales(spark, d).select("id", "sales")


@query("b4_select_numeric", "SELECT id, store_nbr, sales, onpromotion FROM sales")
def b4(spark, d):
    return sc.select_numeric(roles.sales(spark, d))


_STORE_DAYS = f"""store_days AS (
    SELECT s.store_nbr, s.date, round(coalesce(sum(x.sales), 0), 2) AS sales
    FROM {spine_sql('sales', 'store_nbr')} s LEFT JOIN sales x ON s.store_nbr = x.store_nbr AND s.date = x.date GROUP BY ALL)"""


def store_days(spark, d):
    """Daily sales of each store, days without a sale at 0."""
    daily = resample(roles.sales(spark, d), "D", {"sales": "sum"}, by=["store_nbr"])
    return round_all(daily, 2, "sales")


@query("b5_zero_sales", f"{_STORE_DAYS} SELECT store_nbr, date FROM store_days WHERE sales = 0")
def b5(spark, d):
    return store_days(spark, d).filter(F.col("sales") == 0).select("store_nbr", "date")


@query(
    "b5_transferred_holidays",
    """SELECT date, description, count(*) AS n FROM sales JOIN holidays_events USING (date)
    WHERE transferred = true GROUP BY ALL""",
)
def b5_transferred(spark, d):
    moved = roles.holidays_events(spark).filter(F.col("transferred") == F.lit(True))
    return join_calendar(roles.sales(spark, d), moved).groupBy("date", "description").agg(F.count(F.lit(1)).alias("n"))


@query("b6_comparison_filter", "SELECT id, sales FROM sales WHERE sales > 100000")
def b6(spark, d):
    return roles.sales(spark, d).filter(F.col("sales") > 100000).select("id", "sales")


@query(
    "b7_is_null_filter",
    "SELECT s.id FROM sales s LEFT JOIN holidays_events h ON s.date = h.date WHERE h.type IS NULL",
)
def b7(spark, d):
    joined = join_calendar(roles.sales(spark, d), roles.holidays_events(spark), "left")
    return joined.filter(F.col("type").isNull()).select("id")


@query(
    "b8_drop_nulls_any",
    """SELECT s.id, o.dcoilwtico IS NOT NULL AS priced, t.transactions
    FROM sales s JOIN oil o ON s.date = o.date JOIN transactions t ON s.date = t.date AND s.store_nbr = t.store_nbr
    WHERE o.dcoilwtico IS NOT NULL""",
)
def b8(spark, d):
    joined = join_calendar(roles.sales(spark, d), roles.oil(spark, d), "left")
    joined = merge(joined, roles.transactions(spark, d), ["date", "store_nbr"], "left").na.drop(how="any")
    return joined.select("id", F.col("dcoilwtico").isNotNull().alias("priced"), "transactions")


@query("b8_drop_nulls_column", "SELECT date, dcoilwtico FROM oil WHERE dcoilwtico IS NOT NULL")
def b8_column(spark, d):
    return roles.oil(spark, d).na.drop(subset=["dcoilwtico"])


@query(
    "b9_in_list",
    """SELECT s.id, h.description FROM sales s JOIN holidays_events h ON s.date = h.date
    WHERE h.locale IN ('National', 'Regional')""",
)
def b9(spark, d):
    hol = roles.holidays_events(spark).filter(F.col("locale").isin("National", "Regional"))
    return join_calendar(roles.sales(spark, d), hol).select("id", "description")


@query(
    "b10_sales_on_dates",
    "SELECT id, date, sales FROM sales WHERE date IN (SELECT date FROM holidays_events WHERE type = 'Transfer')",
)
def b10(spark, d):
    moved = roles.holidays_events(spark).filter(F.col("type") == "Transfer")
    return sales_on_dates(roles.sales(spark, d), moved).select("id", "date", "sales")


@query("b11_date_range", "SELECT id, date FROM sales WHERE date BETWEEN DATE '2000-01-01' AND DATE '2000-08-15'")
def b11(spark, d):
    lo, hi = F.lit("2000-01-01").cast("date"), F.lit("2000-08-15").cast("date")
    return roles.sales(spark, d).filter(F.col("date").between(lo, hi)).select("id", "date")


@query("b11_year_slice", "SELECT id, date FROM sales WHERE year(date) = 2000")
def b11_year(spark, d):
    return roles.sales(spark, d).filter(cal.in_year("date", 2000)).select("id", "date")


@query("b12_sentinel_to_null", "SELECT date, nullif(dcoilwtico, 0) AS dcoilwtico FROM oil")
def b12(spark, d):
    return roles.oil(spark, d).withColumn("dcoilwtico", sc.null_sentinel("dcoilwtico"))


@query(
    "b13_clip_low",
    """SELECT s.id, CASE WHEN dcoilwtico IS NOT NULL THEN round(greatest(sales - 1000 * dcoilwtico, 0), 6) END AS left_over
    FROM sales s LEFT JOIN oil o ON s.date = o.date""",
)
def b13(spark, d):
    joined = join_calendar(roles.sales(spark, d), roles.oil(spark, d), "left")
    return joined.select("id", F.round(sc.clip_low(F.col("sales") - 1000 * F.col("dcoilwtico")), 6).alias("left_over"))


@query(
    "b14_casts",
    """SELECT s.id, CAST(store_nbr AS VARCHAR) AS store, CAST(transferred AS INTEGER)::BIGINT AS moved,
    onpromotion > 0 AS promoted FROM sales s JOIN holidays_events h ON s.date = h.date""",
)
def b14(spark, d):
    joined = join_calendar(roles.sales(spark, d), roles.holidays_events(spark))
    return joined.select(
        "id",
        F.col("store_nbr").cast("string").alias("store"),
        F.col("transferred").cast("bigint").alias("moved"),
        F.col("onpromotion").cast("boolean").alias("promoted"),
    )


@query(
    "b15_weekend_flag",
    "SELECT CASE WHEN isodow(date) IN (6, 7) THEN 1 ELSE 0 END::BIGINT AS weekend, count(*) AS n, exact_mean(sales) AS sales FROM sales GROUP BY 1",
)
def b15(spark, d):
    flagged = roles.sales(spark, d).withColumn("weekend", cal.weekend("date").cast("bigint"))
    return flagged.groupBy("weekend").agg(F.count(F.lit(1)).alias("n"), exact_mean("sales").alias("sales"))


@query("b16_new_year_flag", "SELECT date, dayofyear(date) = 1 AS new_year, count(*) AS n FROM sales GROUP BY ALL")
def b16(spark, d):
    flagged = roles.sales(spark, d).withColumn("new_year", cal.new_year("date"))
    return flagged.groupBy("date", "new_year").agg(F.count(F.lit(1)).alias("n"))


# Sort, limit, top-k.  The check ignores order, so rank columns show it.


@query("g1_sort_desc", "SELECT store_nbr, round(sum(sales), 2) AS sales FROM sales GROUP BY 1 ORDER BY 2 DESC, 1")
def g1(spark, d):
    out = roles.sales(spark, d).groupBy("store_nbr").agg(F.round(F.sum("sales"), 2).alias("sales"))
    return out.orderBy(F.desc("sales"), F.asc("store_nbr"))


@query("g2_sort_mixed", "SELECT family, date, round(sum(sales), 2) AS sales FROM sales GROUP BY ALL ORDER BY 1 DESC, 2")
def g2(spark, d):
    out = roles.sales(spark, d).groupBy("family", "date").agg(F.round(F.sum("sales"), 2).alias("sales"))
    return out.orderBy(F.desc("family"), F.asc("date"))


@query("g3_sort_composite", "SELECT store_nbr, family, date, sales FROM sales ORDER BY 1, 2, 3")
def g3(spark, d):
    return roles.sales(spark, d).select("store_nbr", "family", "date", "sales").orderBy("store_nbr", "family", "date")


@query("g4_first_rows", "SELECT id, date, sales FROM sales ORDER BY id LIMIT 5")
def g4(spark, d):
    return roles.sales(spark, d).select("id", "date", "sales").orderBy("id").limit(5)


@query(
    "g5_top_groups",
    "SELECT store_nbr, round(sum(sales), 2) AS sales FROM sales GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
)
def g5(spark, d):
    return g1(spark, d).limit(10)


@query("g6_bottom_groups", "SELECT store_nbr, round(sum(sales), 2) AS sales FROM sales GROUP BY 1 ORDER BY 2, 1 LIMIT 10")
def g6(spark, d):
    out = roles.sales(spark, d).groupBy("store_nbr").agg(F.round(F.sum("sales"), 2).alias("sales"))
    return out.orderBy(F.asc("sales"), F.asc("store_nbr")).limit(10)


@query(
    "g7_fixed_category_order",
    """SELECT dayname(date) AS day, isodow(date) AS place, count(*) AS n FROM sales GROUP BY ALL ORDER BY 2""",
)
def g7(spark, d):
    out = roles.sales(spark, d).groupBy(cal.weekday_name("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("place", cal.order_by_name("day", cal.WEEKDAYS)).orderBy("place")


# Scalar functions.


@query("i1_weekday", "SELECT date, isodow(date) - 1 AS from_0, isodow(date) AS from_1 FROM sales GROUP BY 1")
def i1(spark, d):
    days = roles.sales(spark, d).select("date").distinct()
    w = cal.weekday("date").cast("bigint")
    return days.select("date", w.alias("from_0"), (w + 1).alias("from_1"))


@query("i2_weekday_name", "SELECT dayname(date) AS day, exact_mean(sales) AS sales FROM sales GROUP BY 1")
def i2(spark, d):
    return roles.sales(spark, d).groupBy(cal.weekday_name("date").alias("day")).agg(exact_mean("sales").alias("sales"))


@query(
    "i3_month",
    "SELECT month(date) AS month_nbr, monthname(date) AS month, exact_mean(sales) AS sales FROM sales GROUP BY 1, 2",
)
def i3(spark, d):
    keyed = roles.sales(spark, d).groupBy(F.month("date").cast("bigint").alias("month_nbr"), cal.month_name("date").alias("month"))
    return keyed.agg(exact_mean("sales").alias("sales"))


@query("i4_year", "SELECT year(date) AS year, round(sum(sales), 2) AS sales FROM sales GROUP BY 1")
def i4(spark, d):
    return roles.sales(spark, d).groupBy(F.year("date").cast("bigint").alias("year")).agg(F.round(F.sum("sales"), 2).alias("sales"))


@query(
    "i5_day_numbers",
    "SELECT DISTINCT date, day(date) AS day, dayofyear(date) AS day_of_year, weekofyear(date) AS week FROM sales",
)
def i5(spark, d):
    days = roles.sales(spark, d).select("date").distinct()
    return days.select(
        "date",
        F.dayofmonth("date").cast("bigint").alias("day"),
        F.dayofyear("date").cast("bigint").alias("day_of_year"),
        F.weekofyear("date").cast("bigint").alias("week"),
    )


@query(
    "i6_calendar_features",
    """SELECT id, isodow(date) - 1 AS day_of_week, dayname(date) AS day_name, month(date) AS month, year(date) AS year
    FROM sales""",
)
def i6(spark, d):
    return cal.add_calendar(roles.sales(spark, d).select("id", "date")).drop("date")


# Category codes of the merged frame.
LOCALE_CODES = {"National": 1, "Local": 2, "Regional": 3}
STORE_TYPE_CODES = {"A": 1, "B": 2, "C": 3, "D": 4, "E": 5}
HOLIDAY_TYPE_CODES = {"Holiday": 1, "Work Day": 2, "Additional": 3, "Event": 4, "Transfer": 5, "Bridge": 6}


@query(
    "i7_recode",
    """SELECT s.id, CAST(CASE h.type WHEN 'Holiday' THEN 1 WHEN 'Work Day' THEN 2 WHEN 'Additional' THEN 3
    WHEN 'Event' THEN 4 WHEN 'Transfer' THEN 5 WHEN 'Bridge' THEN 6 END AS DOUBLE) AS type,
    CASE h.locale WHEN 'National' THEN 'country' END AS place
    FROM sales s LEFT JOIN holidays_events h ON s.date = h.date""",
)
def i7(spark, d):
    joined = join_calendar(roles.sales(spark, d), roles.holidays_events(spark), "left")
    coded = sc.recode(sc.recode(joined, "type", HOLIDAY_TYPE_CODES), "locale", {"National": "country"}, "place")
    return coded.select("id", F.col("type").cast("double").alias("type"), "place")


@query(
    "i8_math",
    """SELECT id, floor(sales)::BIGINT AS floor, round(sqrt(sales), 4) AS root, round(sales * sales, 1) AS square,
    round(ln(1 + sales), 8) AS log1p, round(sin(2 * pi() * day(date) / 30), 8) AS sine,
    round(cos(2 * pi() * day(date) / 30), 8) AS cosine, round_even(onpromotion / 4.0, 0) AS half_even FROM sales""",
)
def i8(spark, d):
    angle = 2 * F.pi() * F.dayofmonth("date") / 30
    return roles.sales(spark, d).select(
        "id",
        F.floor("sales").alias("floor"),
        F.round(F.sqrt("sales"), 4).alias("root"),
        F.round(F.pow("sales", F.lit(2.0)), 1).alias("square"),
        F.round(F.log1p("sales"), 8).alias("log1p"),
        F.round(F.sin(angle), 8).alias("sine"),
        F.round(F.cos(angle), 8).alias("cosine"),
        F.bround(F.col("onpromotion") / F.lit(4.0), 0).alias("half_even"),
    )


@query(
    "i9_null_test",
    "SELECT date, dcoilwtico IS NULL AS missing, dcoilwtico IS NOT NULL AS known FROM oil",
)
def i9(spark, d):
    c = F.col("dcoilwtico")
    return roles.oil(spark, d).select("date", c.isNull().alias("missing"), (~c.isNull()).alias("known"))


_MERGED = """merged AS (SELECT s.id, h.type, h.locale, t.transactions, o.dcoilwtico
    FROM sales s LEFT JOIN holidays_events h ON s.date = h.date LEFT JOIN oil o ON s.date = o.date
    LEFT JOIN transactions t ON s.date = t.date AND s.store_nbr = t.store_nbr)"""


@query(
    "i10_impute",
    f"""{_MERGED}
SELECT id, coalesce(type, (SELECT type FROM merged WHERE type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS type,
    coalesce(locale, 'none') AS locale,
    coalesce(CAST(transactions AS DOUBLE), (SELECT quantile_cont(CAST(transactions AS DOUBLE), 0.5) FROM merged)) AS transactions,
    coalesce(dcoilwtico, (SELECT floor(quantile_cont(dcoilwtico, 0.5)) FROM merged)) AS dcoilwtico
FROM merged""",
)
def i10(spark, d):
    joined = join_calendar(roles.sales(spark, d), roles.holidays_events(spark), "left")
    joined = join_calendar(joined, roles.oil(spark, d), "left")
    joined = merge(joined, roles.transactions(spark, d), ["date", "store_nbr"], "left")
    joined = joined.select("id", "type", "locale", F.col("transactions").cast("double").alias("transactions"), "dcoilwtico")
    joined = stored(joined, "merged")
    return impute(joined, ["type"], ["transactions"], ["dcoilwtico"], {"locale": "none"})


@query("i10_impute_group_keys", "SELECT family, count(*) AS n FROM sales WHERE family IS NOT NULL GROUP BY 1")
def i10_keys(spark, d):
    return group_agg(roles.sales(spark, d), "family", F.count(F.lit(1)).alias("n"))
