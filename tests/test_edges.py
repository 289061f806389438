"""Small literal frames with known results (FIXTURES.md section 3)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shelfcast.functions import calendar as cal
from shelfcast.functions import scalars as sc
from shelfcast.operators import evaluate as K
from shelfcast.operators import joins as J
from shelfcast.operators import profile as P
from shelfcast.operators import resample as E
from shelfcast.operators import reshape as H
from shelfcast.operators import stats as S
from shelfcast.operators import windows as W
from shelfcast.operators.features import holiday_indicators
from shelfcast.operators.quantiles import mode, quantiles
from shelfcast.operators.regress import fit_ols, ols
from shelfcast.sources import tables


def series(spark, values, kind="double"):
    return spark.createDataFrame(list(enumerate(values)), f"i long, v {kind}")


def column(df, col, order="i"):
    return [r[col] for r in df.orderBy(order).collect()]


def day(text):
    return dt.date.fromisoformat(text)


def test_long_dated_table_is_not_broadcast(spark):
    """The planner decides by the measured size; no hint overrules it."""
    fact = spark.range(200).select(F.date_add(F.lit(day("2000-01-01")), (F.col("id") % 9).cast("int")).alias("date"), "id")
    days = spark.range(50_000).select(F.date_add(F.lit(day("2000-01-01")), F.col("id").cast("int")).alias("date"), F.rand(1).alias("x"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for limit, expected in ((100_000, False), (100_000_000, True)):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
            # the fact is short here, so only the dated side may be what is broadcast: a left join cannot turn it round
            plan = J.join_calendar(fact, days, "left")._jdf.queryExecution().executedPlan().toString()
            assert ("BroadcastHashJoin" in plan) is expected
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert J.join_calendar(fact, days, "left").count() == 200


def test_mean_over_folds(spark):
    got = K.mean_over_folds(spark.createDataFrame([(0, 2.0), (1, 4.0), (2, None)], "fold int, rmse double")).first()
    assert (got["rmse"], got["folds"]) == (3.0, 2)
    assert K.mean_over_folds(spark.createDataFrame([], "fold int, rmse double")).first()["rmse"] is None


def test_interpolation_inside_and_trailing(spark):
    out = W.interpolate(series(spark, [None, 1.0, None, None, 4.0, None]), "i", "v")
    assert column(out, "v") == [None, 1, 2, 3, 4, 4]


def test_interpolation_both_edges(spark):
    out = W.interpolate(series(spark, [None, 1.0, None, None, 4.0, None]), "i", "v", both_edges=True)
    assert column(out, "v") == [1, 1, 2, 3, 4, 4]


def test_moving_average_even_window(spark):
    out = column(W.moving_avg(series(spark, [float(i) for i in range(20)]), "i", "v", 12, 6), "v_ma")
    assert out[:8] == [2.5, 3, 3.5, 4, 4.5, 5, 5.5, 6.5]
    assert out[10] == sum(range(4, 16)) / 12


def test_moving_average_full_window(spark):
    out = column(W.moving_avg(series(spark, [float(i) for i in range(20)]), "i", "v", 7), "v_ma")
    assert out[:5] == [None, None, None, 3, 4]


@pytest.fixture
def gaps(spark):
    rows = [(day("2024-01-01"), 1.0), (day("2024-01-04"), 2.0), (day("2024-01-15"), 3.0)]
    return spark.createDataFrame(rows, "date date, v double")


def test_daily_resample(gaps):
    assert column(E.resample(gaps, "D", {"v": "sum"}), "v", "date")[:4] == [1, 0, 0, 2]
    assert column(E.resample(gaps, "D", {"v": "mean"}), "v", "date")[:4] == [1, None, None, 2]


def test_weekly_and_monthly_resample(gaps):
    weekly = E.resample(gaps, "W", {"v": "mean"}).orderBy("date").collect()
    assert [tuple(r) for r in weekly] == [(day("2024-01-07"), 1.5), (day("2024-01-14"), None), (day("2024-01-21"), 3.0)]
    assert [tuple(r) for r in E.resample(gaps, "M", {"v": "sum"}).collect()] == [(day("2024-01-31"), 6.0)]


def test_monthly_resample_fills_empty_months(spark):
    df = spark.createDataFrame([(day("2023-11-30"), 1.0), (day("2024-02-29"), 2.0)], "date date, v double")
    out = E.resample(df, "M", {"v": "sum"}).orderBy("date").collect()
    assert [tuple(r) for r in out] == [
        (day("2023-11-30"), 1.0), (day("2023-12-31"), 0.0), (day("2024-01-31"), 0.0), (day("2024-02-29"), 2.0)
    ]


def test_resample_per_key_keeps_own_span(spark):
    rows = [("a", day("2024-01-01"), 1.0), ("a", day("2024-01-03"), 2.0), ("b", day("2024-01-10"), 3.0)]
    out = E.resample(spark.createDataFrame(rows, "k string, date date, v double"), "D", {"v": "sum"}, by=["k"])
    assert [r["v"] for r in out.filter("k = 'a'").orderBy("date").collect()] == [1, 0, 2]
    assert [r["v"] for r in out.filter("k = 'b'").collect()] == [3]


def test_null_keys_meet(spark):
    left = spark.createDataFrame([(1, "a"), (None, "b")], "k int, x string")
    right = spark.createDataFrame([(None, "c"), (1, "d")], "k int, y string")
    out = {(r["k"], r["x"], r["y"]) for r in J.merge(left, right, "k", null_safe=True).collect()}
    assert out == {(1, "a", "d"), (None, "b", "c")}
    assert J.merge(left, right, "k").count() == 1


def test_suffixes(spark):
    df = spark.createDataFrame([(1, 2)], "k int, t int")
    assert J.merge(df, df.select("k", (F.col("t") + 1).alias("t")), "k").columns == ["k", "t_x", "t_y"]


def test_salted_join_keeps_every_pair(spark):
    left = spark.range(1000).select(F.when(F.col("id") < 700, 1).otherwise(F.col("id") % 50).alias("k"), "id")
    right = spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left"):
        plain = left.join(right, "k", how)
        salted = J.salted_join(left, right, "k", "id", how, salts=7)
        assert sorted(map(tuple, salted.select("k", "id", "v").collect())) == sorted(
            map(tuple, plain.select("k", "id", "v").collect())
        )


def test_mode_takes_the_smallest(spark):
    df = spark.createDataFrame([(x,) for x in "baba"], "v string")
    assert mode(df, "v").first()[0] == "a"


def test_describe(spark):
    r = P.describe(spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "v double"), ["v"]).first()
    assert (r["mean"], r["q25"], r["q50"], r["q75"]) == (4, 1.75, 2.5, 4.75)
    assert r["std"] == pytest.approx(4.0825, abs=1e-4)


def test_duplicates_and_summary(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (1, 1), (None, 2), (None, 2)], "a int, b int")
    assert P.duplicate_rows(df).first()[0] == 3
    got = {r["column"]: (r["dtype"], r["instances"], r["unique"], r["sum_null"], r["duplicates"]) for r in P.column_summary(df).collect()}
    assert got == {"a": ("int", 3, 1, 2, 3), "b": ("int", 5, 2, 0, 3)}


def test_value_counts_drop_nulls(spark):
    df = spark.createDataFrame([(1,), (1,), (None,)], "v int")
    assert [tuple(r) for r in P.value_counts(df, "v").collect()] == [(1, 2)]


def test_pairwise_correlation(spark):
    df = spark.createDataFrame([(1, 1), (2, 3), (None, 2), (4, None)], "a int, b int")
    assert P.corr_matrix(df, ["a", "b"]).filter("a = 'a' AND b = 'b'").first()["corr"] == pytest.approx(1)


def test_rank_correlation(spark):
    df = spark.createDataFrame([(1, 1), (2, 3), (2, 2), (4, 9)], "a int, b int")
    assert P.corr_spearman(df, "a", "b").first()[0] == pytest.approx(0.948683, abs=1e-6)


def test_histogram_closes_last_bin(spark):
    assert column(P.histogram(series(spark, [0.0, 1.0, 2.0, 3.0, 4.0, 4.0]), "v", 4), "n", "bin") == [1, 1, 1, 3]


def test_calendar_of_new_year_2017(spark):
    df = spark.createDataFrame([(day("2017-01-01"),)], "date date")
    r = df.select(F.weekofyear("date"), cal.weekday("date"), cal.weekend("date"), cal.new_year("date")).first()
    assert tuple(r) == (52, 6, 1, True)


def test_half_even(spark):
    r = spark.range(1).select(F.bround(F.lit(0.125), 2), F.bround(F.lit(0.375), 2), F.bround(F.lit(2.5), 0)).first()
    assert tuple(r) == (0.12, 0.38, 2.0)


def test_recode_unmapped(spark):
    df = spark.createDataFrame([("a",), ("b",)], "v string")
    assert [r[0] for r in sc.recode(df, "v", {"a": 1}).collect()] == [1, None]


def test_null_group_key_is_dropped(spark):
    df = spark.createDataFrame([("a", 1), (None, 2)], "k string, v int")
    assert [tuple(r) for r in P.group_agg(df, "k", F.sum("v").alias("v")).collect()] == [("a", 1)]


def test_wide_to_long_drops_nulls_and_melt_keeps_them(spark):
    df = spark.createDataFrame([(1, 2.0, None)], "i int, a double, b double")
    assert [tuple(r) for r in H.to_long(df, ["i"], ["a", "b"], "n", "v").collect()] == [(1, "a", 2.0)]
    assert H.melt(df, ["i"], ["a", "b"]).count() == 2


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(-1.0,), (None,), (2.0,)], "v double")
    assert [r[0] for r in df.select(sc.clip_low("v")).collect()] == [0, None, 2]


def test_exact_line(spark):
    df = spark.range(10).select(F.col("id").alias("t"), (3.0 + 2.0 * F.col("id")).alias("y"))
    assert fit_ols(df, ["t"], "y").first()["coef"] == pytest.approx([3, 2])
    assert S.ols_line(df, "t", "y").first()["slope"] == pytest.approx(2)
    assert [r["fitted"] for r in ols(df, ["t"], "y").orderBy("t").collect()] == pytest.approx([3 + 2 * i for i in range(10)])


def test_scores_of_equal_series(spark):
    df = series(spark, [1.0, 2.0, 5.0])
    r = df.agg(K.rmse("v", "v"), K.rmsle("v", "v"), K.r2("v", "v")).first()
    assert tuple(r) == (0, 0, 1)


def test_negative_value_stops_rmsle(spark):
    with pytest.raises(Exception, match="clip at 0"):
        series(spark, [-1.0, 2.0]).agg(K.rmsle("v", "v")).collect()


def test_weekly_sine_has_one_peak(spark):
    df = spark.range(364).select("id", F.sin(F.col("id") * (2 * 3.141592653589793 / 7)).alias("y"))
    top = S.periodogram(df, "id", "y").orderBy(F.desc("power")).limit(2).collect()
    assert top[0]["frequency"] == pytest.approx(365 / 7) and top[0]["power"] > 20 * top[1]["power"]


def test_holiday_rows_fan_out_but_features_do_not(spark):
    d = day("2000-12-24")
    fact = spark.createDataFrame([(d, 1.0)], "date date, sales double")
    hol = spark.createDataFrame([(d, "National", "x"), (d, "National", "y")], "date date, locale string, description string")
    assert J.join_calendar(fact, hol).count() == 2
    flags = holiday_indicators(hol, ["National"], "2000-01-01", "2000-12-31", ["x", "y"])
    assert [tuple(r) for r in J.fill_after_join(fact, flags).collect()] == [(d, 1.0, 1.0, 1.0)]


def test_empty_frames(spark):
    empty = spark.createDataFrame([], "i long, date date, k string, v double, w double")
    for out in (
        W.interpolate(empty, "i", "v"),
        W.moving_avg(empty, "i", "v", 7),
        W.lag(empty, "date", "v"),
        W.time_step(empty, "i"),
        W.zscore(empty, "v"),
        W.zscore(empty, "v", ["k"]),
        E.resample(empty, "D", {"v": "sum"}),
        E.resample(empty, "M", {"v": "mean"}, by=["k"]),
        P.value_counts(empty, "k"),
        quantiles(empty, "v", {"m": 0.5}, ["k"]),
        fit_ols(empty, ["w"], "v"),
        fit_ols(empty, ["w"], "v", ["k"]),
        ols(empty, ["w"], "v"),
        S.pacf(empty, "date", "v", by=["k"]),
        S.periodogram(empty, "date", "v"),
        S.kde(empty, "v").filter("density IS NOT NULL"),
        H.label_encode(empty, "k"),
        H.encode_first_seen(empty, "k", "i"),
        K.assign_folds(empty, "i", 3),
        K.holdout_last(empty, "i", 3),
        J.merge(empty, empty.select("k"), "k", null_safe=True),
    ):
        assert out.collect() == []
    assert quantiles(empty, "v", {"m": 0.5}).first()[0] is None
    assert P.histogram(empty, "v", 4).agg(F.sum("n")).first()[0] == 0
    assert P.corr_spearman(empty, "v", "w").first()[0] is None


def test_csv_round_trip(spark, tmp_path):
    (tmp_path / "oil.csv").write_text("date,dcoilwtico\n2013-01-01,\n2013-01-02,93.14\n2013-01-03,NaN\n")
    out = tables.read_table(spark, str(tmp_path), "oil")
    assert column(out, "dcoilwtico", "date") == [None, 93.14, None] and out.schema["date"].dataType.typeName() == "date"
    text = spark.createDataFrame([("2017-08-15",)], "d string")
    assert tables.parse_date(text, "d").first()[0] == day("2017-08-15")
    df = spark.createDataFrame([(1, 2.5, "x")], "id long, sales double, other string")
    path = str(tmp_path / "out")
    tables.write_submission(df, path)
    assert [tuple(r) for r in spark.read.option("header", True).csv(path).collect()] == [("1", "2.5")]
    with pytest.raises(Exception):
        tables.write_submission(df, path)


def test_split_marks_the_same_rows_on_any_layout(spark):
    df = spark.range(20000)
    marks = [sorted(map(tuple, sc.split_random(df.repartition(n), "id").collect())) for n in (1, 13)]
    assert marks[0] == marks[1]
    assert sum(m for _, m in marks[0]) / 20000 == pytest.approx(0.2, abs=0.01)
