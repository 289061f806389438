"""Work cut into blocks gives what one window gives, also when one key holds a third of the rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfcast.operators import evaluate as K
from shelfcast.operators import ordered as O
from shelfcast.operators import profile as P
from shelfcast.operators import windows as W
from shelfcast.operators.quantiles import quantiles
from shelfcast.operators.reshape import label_codes

N = 600


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(1)
    keys = np.where(np.arange(N) % 3 == 0, "hot", np.array(["a", "b", "c", "d"])[np.arange(N) % 4])
    values = np.round(rng.normal(size=N), 2)
    holes = np.where(rng.random(N) < 0.6, None, values)
    holes[:40] = None
    holes[-60:] = None
    return pd.DataFrame({"id": np.arange(N) * 7 - 300, "k": keys, "w": rng.integers(1, 5, N), "v": values, "h": holes})


@pytest.fixture(scope="module")
def df(spark, table):
    rows = [(int(r.id), r.k, int(r.w), float(r.v), None if r.h is None else float(r.h)) for r in table.itertuples()]
    return spark.createDataFrame(rows, "id long, k string, w int, v double, h double").repartition(5).cache()


@pytest.fixture(scope="module")
def points(df):
    found = O.split_points(df, "id", rows_per_block=50)
    assert len(found) >= 10
    return found


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


@pytest.mark.parametrize("by", [[], ["k"]])
def test_blocks_equal_one_window(df, points, by):
    def all_of(p):
        return [
            rows(O.running_totals(df, "id", {"s": F.col("w"), "n": F.lit(1)}, by, p).select("id", "s", "s_all", "n", "n_all"), "id"),
            rows(O.position(df, "id", by, points=p).select("id", "t"), "id"),
            rows(W.interpolate(df, "id", "h", by, points=p).select("id", F.round("h", 9)), "id"),
            rows(W.interpolate(df, "id", "h", by, True, points=p).select("id", F.round("h", 9)), "id"),
            rows(K.holdout_last(df, "id", 70, by, p).select("id", "is_test"), "id"),
        ]

    for cut, whole in zip(all_of(points), all_of([])):
        assert cut == whole


@pytest.mark.parametrize("by", [[], ["k"]])
@pytest.mark.parametrize("size", [1, 20, 64])
def test_windows_with_reach_equal_one_window(df, points, by, size):
    def columns(spec):
        return {
            "a": F.lag("v", 3).over(spec),
            "b": F.lead("v", 5).over(spec),
            "c": F.round(F.sum("v").over(spec.rowsBetween(-5, 4)), 9),
        }

    cut = O.over_rows(df, "id", columns, 5, by, points, size).select("id", "a", "b", "c")
    whole = O.over_rows(df, "id", columns, 5, by, []).select("id", "a", "b", "c")
    assert rows(cut, "id") == rows(whole, "id")


def test_lags_and_averages_in_blocks(df, points):
    for by in ([], ["k"]):
        for make in (
            lambda p: W.moving_avg(df, "id", "v", 12, 6, by, "o", p),
            lambda p: W.lag(df, "id", "v", 2, by, "o", p),
            lambda p: W.lead(df, "id", "v", 2, by, "o", p),
        ):
            got, want = (rows(make(p).select("id", F.round("o", 9)), "id") for p in (points, []))
            assert got == want


def test_folds_and_their_sizes(df, points, table):
    for p in (points, []):
        got = rows(K.assign_folds(df, "id", 7, points=p).select("id", "fold"), "id")
        want = np.concatenate([[i] * len(part) for i, part in enumerate(np.array_split(np.arange(N), 7))])
        assert [f for _, f in got] == want.tolist()


def test_quantiles_equal_numpy(df, table):
    probs = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p99": 0.99}
    cuts = O.split_points(df, "v", rows_per_block=40)
    for p in ([], cuts):
        got = quantiles(df, "v", probs, points=p).first()
        assert list(got) == pytest.approx(np.quantile(table.v, list(probs.values())))
        for r in quantiles(df, "v", probs, ["k"], p).collect():
            assert list(r)[1:] == pytest.approx(np.quantile(table.v[table.k == r["k"]], list(probs.values())))


def test_rank_correlation_in_blocks(df, table):
    want = table.v.rank().corr(table.w.rank())
    for p in ([], [-1.0, -0.3, 0.2, 1.0, 2.0, 3.0]):
        assert P.corr_spearman(df, "v", "w", p).first()[0] == pytest.approx(want)


def test_text_order_in_blocks(spark):
    words = [f"{a}{b}é" for a in "zyxabc" for b in ("", "a", "Z", "longer text", "日本")]
    df = spark.createDataFrame([(w,) for w in words], "s string")
    points = O.split_points(df, "s", rows_per_block=5)
    assert points
    got = {r["s"]: r["c"] for r in O.position(df.distinct(), "s", name="c", points=points).collect()}
    assert got == {w: i for i, w in enumerate(sorted(set(words), key=lambda w: w.encode()))}
    assert {r["s"]: r["c"] for r in label_codes(df, "s", "c").collect()} == got


def test_short_date_orders_are_not_cut(spark):
    days = spark.sql("SELECT explode(sequence(DATE'2000-01-01', DATE'2000-12-31')) AS date")
    assert O.split_points(days, "date") == []
    assert O.split_points(days, "date", rows_per_block=30)


@pytest.mark.parametrize("by", [[], ["k"]])
def test_null_orders_and_keys_stay(spark, by):
    rows_ = [(i, "a" if i % 3 else None, float(i) if i % 4 else None) for i in range(30)] + [(None, "a", 7.0)]
    df = spark.createDataFrame(rows_, "id long, k string, h double")
    for make in (
        lambda p: O.position(df, "id", by, "t", p),
        lambda p: W.interpolate(df, "id", "h", by, points=p),
        lambda p: K.holdout_last(df, "id", 5, by, p),
        lambda p: O.over_rows(df, "id", lambda w: {"x": F.lag("h").over(w)}, 1, by, p, rows_per_block=4),
    ):
        cut, whole = (sorted(map(str, make(p).collect())) for p in ([5.0, 12.0, 20.0], []))
        assert cut == whole and len(cut) == len(rows_)
    assert W.zscore(df, "h", ["k"]).count() == len(rows_)
    assert P.box_stats(df.dropna(subset=["h"]), "h", ["k"]).count() == 2


def test_text_with_a_common_start_is_cut(spark):
    df = spark.range(3000).select(F.format_string("https://shop/%06d", (F.col("id") * 7919) % 3000).alias("s"))
    points = O.split_points(df, "s", rows_per_block=300)
    assert len(points) >= 8
    sizes = [r["count"] for r in O.with_block(df, "s", points).groupBy("_block").count().collect()]
    assert max(sizes) < 700
    got = [r["s"] for r in O.position(df, "s", name="c", points=points).orderBy("c").collect()]
    assert got == sorted(got)


def test_tables_of_some_size_are_cut(spark):
    df = spark.range(60_000).select(F.col("id"), F.expr("date_add(DATE'2000-01-01', cast(id % 900 as int))").alias("date"))
    assert O.split_points(df, "id") and O.split_points(df, "date")
