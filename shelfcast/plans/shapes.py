"""Long and wide forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfcast.operators import reshape as H
from shelfcast.operators.joins import join_calendar
from shelfcast.operators.resample import resample
from shelfcast.functions.scalars import null_sentinel
from shelfcast.operators.windows import interpolate
from shelfcast.plans.joining import DAILY_OIL
from shelfcast.plans.registry import query
from shelfcast.plans.time_axis import DAILY_FAMILY, daily_total
from shelfcast.sources import roles

_FAMILIES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
_WIDE = ", ".join(f"max(CASE WHEN family = '{f}' THEN sales END) AS {f}" for f in _FAMILIES)


@query("h1_long_to_wide", f"{DAILY_FAMILY} SELECT date, {_WIDE} FROM daily GROUP BY 1")
def h1(spark, d):
    values = H.values_of(roles.families(spark, d), "family")
    return H.to_wide(daily_total(spark, d, "family"), ["date"], "family", "sales", values)


@query("h2_wide_to_long", f"{DAILY_FAMILY} SELECT date, family, sales FROM daily")
def h2(spark, d):
    wide = h1(spark, d)
    return H.to_long(wide, ["date"], [c for c in wide.columns if c != "date"], "family", "sales")


@query(
    "h3_melt_with_legend",
    f"""{DAILY_OIL}, both_prices AS (SELECT date, v AS dcoilwtico, daily_oil.dcoilwtico AS filled FROM oil_days JOIN daily_oil USING (date))
    SELECT date, 'dcoilwtico' AS "Legend", dcoilwtico AS value FROM both_prices
    UNION ALL SELECT date, 'filled', filled FROM both_prices""",
)
def h3(spark, d):
    daily = resample(roles.oil(spark, d), "D", {"dcoilwtico": "sum"})
    daily = daily.withColumn("dcoilwtico", null_sentinel("dcoilwtico", 0.0))
    both = interpolate(daily, "date", "dcoilwtico", both_edges=True, out="filled")
    return H.melt(both, ["date"], ["dcoilwtico", "filled"])


@query(
    "h4_dummies",
    "SELECT id, " + ", ".join(f"CAST(family = '{f}' AS DOUBLE) AS family_{f}" for f in _FAMILIES) + " FROM sales",
)
def h4(spark, d):
    values = H.values_of(roles.families(spark, d), "family")
    return H.get_dummies(roles.sales(spark, d).select("id", "family"), "family", values).drop("family")


@query(
    "h4_holiday_dummies_by_date",
    """SELECT date, max(CAST(h.description = 'Year end' AS DOUBLE)) AS year_end,
    max(CAST(h.description = 'Year end bridge' AS DOUBLE)) AS bridge, count(*) AS n FROM sales JOIN holidays_events h USING (date) GROUP BY 1""",
)
def h4_by_date(spark, d):
    held = join_calendar(roles.sales(spark, d), roles.holidays_events(spark))
    flags = H.dummies_by(held, "date", "description", ["Year end", "Year end bridge"], "hol")
    counts = held.groupBy("date").agg(F.count(F.lit(1)).alias("n"))
    return flags.join(counts, "date").select(
        "date", F.col("hol_Year end").alias("year_end"), F.col("hol_Year end bridge").alias("bridge"), "n"
    )


@query("h5_one_series", f"{DAILY_FAMILY} SELECT date, sales FROM daily WHERE family = 'PROMO'")
def h5(spark, d):
    return daily_total(spark, d, "family").filter(F.col("family") == "PROMO").select("date", "sales")


@query(
    "h5_first_series_by_name",
    f"{DAILY_FAMILY} SELECT family, date, sales FROM daily WHERE family IN (SELECT family FROM families ORDER BY 1 LIMIT 3)",
)
def h5_first(spark, d):
    first = roles.families(spark, d).orderBy("family").limit(3).select("family")
    return daily_total(spark, d, "family").join(first, "family", "left_semi").select("family", "date", "sales")


@query(
    "j7_label_codes",
    "SELECT s.id, f.family_code, dense_rank() OVER (ORDER BY t.city) - 1 AS city_code FROM sales s JOIN families f USING (family) JOIN stores t USING (store_nbr)",
)
def j7(spark, d):
    """Families and cities by their place in sorted order."""
    placed = roles.sales(spark, d).join(roles.stores(spark, d).select("store_nbr", "city"), "store_nbr")
    city = H.label_codes(roles.stores(spark, d), "city", "city_code")
    out = H.label_encode(H.label_encode(placed, "family", fitted=roles.families(spark, d)), "city", "city_code", city)
    return out.select("id", "family_code", "city_code")


@query(
    "j7_one_fit_for_train_and_test",
    "SELECT 'train' AS part, family, family_code, count(*) AS n FROM sales JOIN families USING (family) GROUP BY ALL "
    "UNION ALL SELECT 'test', family, family_code, count(*) FROM test JOIN families USING (family) GROUP BY ALL",
)
def j7_both(spark, d):
    train, test = roles.sales(spark, d).select("family"), roles.test(spark, d).select("family")
    codes = H.label_codes(train.unionByName(test), "family", "family_code", points=[])
    parts = [H.label_encode(df, "family", fitted=codes).withColumn("part", F.lit(p)) for p, df in (("train", train), ("test", test))]
    return parts[0].unionByName(parts[1]).groupBy("part", "family", "family_code").agg(F.count(F.lit(1)).alias("n"))
