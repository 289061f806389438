"""The retail tables as views over the driver's Parquet files (FIXTURES.md section 2).

Each role is built to a unique grain before anything ordered runs on it.
``ROLE_SQL`` holds the same definitions for the checking database; ``exact_mean`` in it is spelled out by
``plans/registry.py``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.functions.calendar import date_spine, weekday
from shelfcast.operators.reshape import label_codes
from shelfcast.sources.scratch import stored

DAY_ZERO = "1995-01-01"
HOLIDAY_SPAN = ("1995-01-01", "2001-12-31")
OIL_SPAN = ("1995-01-02", "2001-08-01")
MODEL_YEAR = 2000
STORE_SLOTS = 10_000_000_000  # room for store numbers inside an id
HORIZON = 16
LINES_PER_TASK = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _row_id(date, store, code):
    days = F.datediff(date, F.lit(DAY_ZERO).cast("date")).cast("bigint")
    return (days * F.lit(STORE_SLOTS) + store) * 10 + code


def families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product families with their code in sorted order."""
    kinds = table(spark, sf_dir, "part").select(F.col("p_type").alias("family")).distinct()
    return label_codes(kinds, "family", "family_code", points=[])  # part types are a short fixed list


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with their family and its code.

    The code is put on the parts, never joined to the lines by family: that would
    shuffle them on a handful of keys.  Whether the parts are broadcast is left to
    the size statistics of the scan.
    """
    kinds = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("family"))
    part = kinds.join(stored(families(spark, sf_dir), "families"), "family")
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_shipdate").cast("date").alias("date"), "l_suppkey", "l_partkey", "l_extendedprice", "l_discount"
    )
    return lines.join(part, lines.l_partkey == part.p_partkey)


def _to_sales(lines: DataFrame, store: str) -> DataFrame:
    fact = lines.groupBy("date", F.col(store).cast("bigint").alias("store_nbr"), "family", "family_code").agg(
        F.round(F.sum("l_extendedprice"), 2).alias("sales"),
        F.sum(F.round(F.col("l_discount") * 100)).cast("bigint").alias("onpromotion"),
    )
    return fact.select(
        _row_id(F.col("date"), F.col("store_nbr"), F.col("family_code")).alias("id"),
        "date",
        "store_nbr",
        "family",
        "sales",
        "onpromotion",
    )


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (date, store, family)."""
    return _to_sales(_lines(spark, sf_dir), "l_suppkey")


def panel_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``sales`` with the supplier's nation as the store."""
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    lines = _lines(spark, sf_dir)
    return _to_sales(lines.join(supplier, lines.l_suppkey == supplier.s_suppkey), "s_nationkey")


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    placed = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).join(
        region, nation.n_regionkey == region.r_regionkey
    )
    return placed.select(
        F.col("s_suppkey").alias("store_nbr"),
        F.col("n_name").alias("city"),
        F.col("r_name").alias("state"),
        F.substring(F.lit("ABCDE"), (F.col("s_suppkey") % 5 + 1).cast("int"), F.lit(1)).alias("type"),
        (F.col("s_nationkey") % 17).cast("bigint").alias("cluster"),
    )


def oil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A price per weekday with nulls and zeros.  One row per day, so its size is bounded by the calendar."""
    priced = (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_orderdate").cast("date").alias("date"))
        .agg((F.avg(F.col("o_totalprice").cast("decimal(18,2)")).cast("double") / 1000).alias("price"))
    )
    # The fixed span, drawn out to where there are orders before or after it.
    first, last = (F.lit(x).cast("date") for x in OIL_SPAN)
    span = priced.agg(F.least(first, F.min("date")).cast("string"), F.greatest(last, F.max("date")).cast("string")).first()
    days = date_spine(spark, *span).filter(weekday("date") < 5)
    missing = (F.col("date") < F.lit("1995-01-05").cast("date")) | (F.dayofmonth("date") == 13)
    return days.join(priced, "date", "left").select(
        "date",
        F.when(missing, F.lit(None).cast("double"))
        .when(F.dayofmonth("date") == 7, F.lit(0.0))
        .otherwise(F.col("price"))
        .alias("dcoilwtico"),
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders per (date, store).

    Both sides are dealt by order over tasks of a fixed number of lines and cut down there to what differs, so the
    join needs no further shuffle, gives each (order, date, store) once, and what a task sorts and holds does not
    grow with the tables.
    """
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("date"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("store_nbr"))
    tasks = _tasks(spark, lines.count())  # taken from the files' footers
    lines = lines.repartition(tasks, "l_orderkey").distinct()
    orders = orders.repartition(tasks, "o_orderkey").distinct()
    pairs = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    return pairs.groupBy("date", "store_nbr").agg(F.count(F.lit(1)).alias("transactions"))


def _tasks(spark: SparkSession, rows: int) -> int:
    """So many that none gets more than ``LINES_PER_TASK`` rows on average; fewer rows are shared by the session's cores."""
    return max(-(-rows // LINES_PER_TASK), min(spark.sparkContext.defaultParallelism, 1 + 10 * rows // LINES_PER_TASK))


def holidays_events(spark: SparkSession, sf_dir: str | None = None) -> DataFrame:
    """The holiday calendar; a date may have two rows.  Bounded by the calendar."""
    day = F.col("date")
    month, dom, odd = F.month(day), F.dayofmonth(day), F.year(day) % 2 == 1

    def rule(when, kind, locale, place, text, moved=F.lit(False)):
        row = F.struct(
            F.lit(kind).alias("type"),
            F.lit(locale).alias("locale"),
            (place if not isinstance(place, str) else F.lit(place)).alias("locale_name"),
            F.lit(text).alias("description"),
            moved.alias("transferred"),
        )
        return F.when(when, row)

    rules = [
        rule((month == 1) & (dom == 1), "Holiday", "National", "ALL", "New Year"),
        rule((month == 5) & (dom == 1), "Holiday", "National", "ALL", "Labour Day", odd),
        rule((month == 5) & (dom == 4) & odd, "Transfer", "National", "ALL", "Labour Day moved"),
        rule((month == 12) & dom.between(20, 26), "Additional", "National", "ALL", "Year end"),
        rule((month == 12) & (dom == 24), "Bridge", "National", "ALL", "Year end bridge"),
        rule((month == 1) & (dom == 9), "Work Day", "National", "ALL", "Recovery"),
        rule((month == 7) & dom.between(10, 14), "Event", "National", "ALL", "Fair"),
        rule((month == 10) & (dom == 9), "Holiday", "Regional", "ASIA", "Regional day"),
        rule(dom == 15, "Holiday", "Local", F.concat(F.lit("NATION_"), (month - 1).cast("string")), "Local day"),
    ]
    return (
        date_spine(spark, *HOLIDAY_SPAN)
        .withColumn("h", F.explode(F.array_compact(F.array(*rules))))
        .select("date", "h.*")
    )


def test(spark: SparkSession, sf_dir: str, fact: DataFrame | None = None, store_list: DataFrame | None = None) -> DataFrame:
    """The 16 days after the last sale for every store and family.

    Days and families are small value lists put into each store's row and
    exploded there, so no pairing join is planned.
    """
    fact = sales(spark, sf_dir) if fact is None else fact
    store_list = stores(spark, sf_dir).select("store_nbr") if store_list is None else store_list
    last = fact.agg(F.max("date").alias("d")).scalar()
    codes = families(spark, sf_dir).agg(F.collect_set(F.struct("family", "family_code"))).scalar()
    rows = (
        store_list.withColumn("date", F.explode(F.sequence(F.date_add(last, 1), F.date_add(last, HORIZON))))
        .withColumn("f", F.explode(codes))
        .select("date", "store_nbr", "f.family", "f.family_code")
    )
    return rows.select(
        _row_id(F.col("date"), F.col("store_nbr"), F.col("family_code")).alias("id"),
        "date",
        "store_nbr",
        "family",
        ((F.col("store_nbr") * 7 + F.dayofmonth("date")) % 11).cast("bigint").alias("onpromotion"),
    )


def panel_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``test`` for the stores of the panel."""
    nations = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("bigint").alias("store_nbr")).distinct()
    return test(spark, sf_dir, panel_sales(spark, sf_dir), nations)


_SALES = """
SELECT (datediff('day', DATE '1995-01-01', date) * 10000000000 + store_nbr) * 10 + family_code AS id,
       date, store_nbr, f.family, sales, onpromotion
FROM (SELECT CAST(l_shipdate AS DATE) AS date, CAST({store} AS BIGINT) AS store_nbr, p_type AS family,
             round(sum(l_extendedprice), 2) AS sales,
             CAST(sum(round(l_discount * 100)) AS BIGINT) AS onpromotion
      FROM lineitem JOIN part ON l_partkey = p_partkey {extra}
      GROUP BY ALL) x JOIN families f USING (family)"""

_TEST = """
SELECT (datediff('day', DATE '1995-01-01', date) * 10000000000 + store_nbr) * 10 + family_code AS id,
       date, store_nbr, family, (store_nbr * 7 + day(date)) % 11 AS onpromotion
FROM (SELECT CAST(max(date) + CAST(k AS INTEGER) AS DATE) AS date FROM {fact}, range(1, 17) r(k) GROUP BY k),
     ({stores}), families"""

ROLE_SQL = {
    "families": """
SELECT p_type AS family, row_number() OVER (ORDER BY p_type) - 1 AS family_code
FROM (SELECT DISTINCT p_type FROM part)""",
    "sales": _SALES.format(store="l_suppkey", extra=""),
    "panel_sales": _SALES.format(store="s_nationkey", extra="JOIN supplier ON l_suppkey = s_suppkey"),
    "stores": """
SELECT s_suppkey AS store_nbr, n_name AS city, r_name AS state,
       substr('ABCDE', CAST(s_suppkey % 5 + 1 AS INTEGER), 1) AS type, CAST(s_nationkey % 17 AS BIGINT) AS cluster
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "oil": """
SELECT d.date, CASE WHEN d.date < DATE '1995-01-05' OR day(d.date) = 13 THEN NULL
                    WHEN day(d.date) = 7 THEN 0.0 ELSE price END AS dcoilwtico
FROM (SELECT CAST(unnest(generate_series(
        CAST(least(DATE '1995-01-02', CAST(min(o_orderdate) AS DATE)) AS TIMESTAMP),
        CAST(greatest(DATE '2001-08-01', CAST(max(o_orderdate) AS DATE)) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM orders) d
LEFT JOIN (SELECT CAST(o_orderdate AS DATE) AS date, exact_mean(o_totalprice) / 1000 AS price
           FROM orders GROUP BY 1) u ON d.date = u.date
WHERE isodow(d.date) < 6""",
    "transactions": """
SELECT CAST(o_orderdate AS DATE) AS date, l_suppkey AS store_nbr, count(DISTINCT o_orderkey) AS transactions
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2""",
    "holidays_events": """
SELECT date, r.type, r.locale, CASE WHEN r.locale = 'Local' THEN 'NATION_' || (month(date) - 1) ELSE r.place END AS locale_name,
       r.text AS description, r.text = 'Labour Day' AND year(date) % 2 = 1 AS transferred
FROM (SELECT CAST(x AS DATE) AS date FROM range(DATE '1995-01-01', DATE '2002-01-01', INTERVAL 1 DAY) q(x)) d
JOIN (VALUES (1, 1, 1, 'Holiday', 'National', 'ALL', 'New Year'), (5, 1, 1, 'Holiday', 'National', 'ALL', 'Labour Day'),
             (5, 4, 4, 'Transfer', 'National', 'ALL', 'Labour Day moved'),
             (12, 20, 26, 'Additional', 'National', 'ALL', 'Year end'),
             (12, 24, 24, 'Bridge', 'National', 'ALL', 'Year end bridge'),
             (1, 9, 9, 'Work Day', 'National', 'ALL', 'Recovery'), (7, 10, 14, 'Event', 'National', 'ALL', 'Fair'),
             (10, 9, 9, 'Holiday', 'Regional', 'ASIA', 'Regional day'), (NULL, 15, 15, 'Holiday', 'Local', '', 'Local day')
     ) r(m, lo, hi, type, locale, place, text)
ON (r.m IS NULL OR month(date) = r.m) AND day(date) BETWEEN r.lo AND r.hi
   AND (r.type <> 'Transfer' OR year(date) % 2 = 1)""",
    "test": _TEST.format(fact="sales", stores="SELECT store_nbr FROM stores"),
    "panel_test": _TEST.format(
        fact="panel_sales", stores="SELECT DISTINCT CAST(s_nationkey AS BIGINT) AS store_nbr FROM supplier"
    ),
}


_BUILT_FROM = {
    "sales": ["families"],
    "panel_sales": ["families"],
    "test": ["families", "sales", "stores"],
    "panel_test": ["families", "panel_sales"],
}


def with_roles(body: str) -> str:
    """Put the definitions of the roles that ``body`` reads in front of it."""
    wanted: list[str] = []
    for name in ROLE_SQL:
        if re.search(rf"(?i)\b(from|join)\s+{name}\b", body):
            wanted += [n for n in [*_BUILT_FROM.get(name, []), name] if n not in wanted]
    ctes = [f"{name} AS MATERIALIZED ({ROLE_SQL[name].strip()})" for name in wanted]
    body = body.strip()
    if re.match(r"(?i)select\b", body):
        return ("WITH RECURSIVE " + ",\n".join(ctes) + "\n" if ctes else "") + body
    return "WITH RECURSIVE " + ",\n".join([*ctes, body])
