"""Trees on weighted cells against Spark ML's trees on the unweighted rows, and folds against plain fits."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from shelfcast.operators import boosting as B
from shelfcast.operators import forecast as M
from shelfcast.operators.evaluate import assign_folds

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    n = 4000
    a, b, c = rng.integers(0, 5, n), rng.integers(0, 8, n), rng.random(n)
    y = 10 * np.sin(a) + (b % 3) * 3 + 20 * (c > 0.4) * (a > 2) + rng.normal(0, 3, n)
    data = [(i, int(p), int(q), float(r), float(s)) for i, (p, q, r, s) in enumerate(zip(a, b, c, y))]
    return spark.createDataFrame(data, "id long, a int, b int, c double, y double").repartition(4).cache()


def _unweighted(rows, bins, rounds, depth):
    """Spark ML's boosted trees on every row's bins."""
    placed = bins.place(rows).withColumns({c: F.col(c).alias(c, metadata={}) for c in bins.columns()})
    vectors = VectorAssembler(inputCols=bins.columns(), outputCol="features").transform(placed)
    trees = GBTRegressor(labelCol="y", predictionCol="p", maxIter=rounds, maxDepth=depth, maxBins=B.BINS + 2)
    return trees.fit(vectors).transform(vectors)


@pytest.mark.parametrize("rounds, depth", [(1, 3), (12, 4)])
def test_cells_give_the_trees_of_the_rows(spark, rows, rounds, depth):
    model = B.fit_boosted(rows, FEATURES, "y", rounds, depth)
    assert B.cells(rows, model.bins, "y").count() < rows.count()
    got = {r["id"]: r["predicted"] for r in model.transform(rows).collect()}
    want = {r["id"]: r["p"] for r in _unweighted(rows, model.bins, rounds, depth).collect()}
    assert got == pytest.approx(want, rel=1e-9, abs=1e-9)


def test_large_tables_of_cells_are_fitted_by_distributed_trees(spark, rows, monkeypatch):
    small = B.fit_boosted(rows, FEATURES, "y", 6, 3).transform(rows)
    monkeypatch.setattr(B, "MOST_CELLS", 10)
    large = B.fit_boosted(rows, FEATURES, "y", 6, 3).transform(rows)
    assert small.columns == large.columns
    got, want = ({r["id"]: r["predicted"] for r in x.collect()} for x in (large, small))
    assert got == pytest.approx(want, rel=1e-9, abs=1e-9)


def test_folds_match_fits_without_them(spark, rows, monkeypatch):
    folds = assign_folds(rows, "id", 3).cache()
    scores = {r["fold"]: (r["rmse"], r["n"]) for r in M.cv_boosted(folds, 3, FEATURES, "y", rounds=8, depth=4).collect()}
    assert set(scores) == {0, 1, 2}
    bins = B.binning(folds, FEATURES)
    for i, (rmse, n) in scores.items():
        monkeypatch.setattr(B, "binning", lambda *_: bins)
        model = B.fit_boosted(folds.filter(F.col("fold") != i), FEATURES, "y", 8, 4)
        held = model.transform(folds.filter(F.col("fold") == i))
        want = held.agg(F.sqrt(F.avg(F.pow(F.col("y") - F.col("predicted"), 2))), F.count("y")).first()
        assert (rmse, n) == (pytest.approx(want[0], rel=1e-9), want[1])
    monkeypatch.setattr(B, "MOST_CELLS", 10)
    large = {r["fold"]: (r["rmse"], r["n"]) for r in M.cv_boosted(folds, 3, FEATURES, "y", rounds=8, depth=4).collect()}
    assert {k: v[0] for k, v in large.items()} == pytest.approx({k: v[0] for k, v in scores.items()}, rel=1e-9)


def test_folds_do_not_multiply_the_cells_of_a_model(spark, rows, monkeypatch):
    """What bounds a model is the number of vectors, however many folds each of them is in."""
    folds = assign_folds(rows.withColumn("c", F.round("c", 1)), "id", 5).cache()
    want = M.cv_boosted(folds, 5, FEATURES, "y", rounds=4, depth=3).toPandas().sort_values("fold")
    vectors = B.cells(folds, B.binning(folds, FEATURES), "y").count()
    monkeypatch.setattr(B, "MOST_CELLS", vectors)
    monkeypatch.setattr(B, "_distributed_folds", lambda *_: pytest.fail("one job a level"))
    got = M.cv_boosted(folds, 5, FEATURES, "y", rounds=4, depth=3).toPandas().sort_values("fold")
    assert got["n"].sum() == 4000 and got["rmse"].tolist() == pytest.approx(want["rmse"].tolist(), rel=1e-9)


def test_the_hybrid_fits_what_its_line_leaves(spark, rows):
    frame = rows.select(
        F.concat(F.lit("f"), F.col("a")).alias("family"), F.expr("date_add(date'2000-01-01', cast(b as int))").alias("date"),
        F.col("b").alias("t"), F.col("y").alias("sales"), (F.col("c") * 4).cast("int").alias("onpromotion"),
    )
    out = M.hybrid_fit(frame, rounds=20, depth=4).predict(frame)
    assert {"stage_1", "predicted"} <= set(out.columns) and not {"_code", "_day", "residual", "slope"} & set(out.columns)
    miss = out.agg(*[F.sqrt(F.avg(F.pow(F.col("sales") - F.col(c), 2))) for c in ("stage_1", "predicted")]).first()
    assert miss[1] < miss[0]


def test_missing_values_constants_and_no_rows(spark):
    rows = [(float(i % 3) if i % 4 else None, 1.0, 5.0 if i % 4 else 50.0) for i in range(40)] + [(1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    out = B.fit_boosted(df, ["a", "b"], "y", 3, 2).transform(df)
    assert out.count() == 41
    assert out.filter("a IS NULL").agg(F.min("predicted")).first()[0] > 40
    with pytest.raises(ValueError):
        B.fit_boosted(df.limit(0), ["a", "b"], "y", 2, 2)


def test_more_values_than_bins_are_cut_at_quantiles(spark):
    df = spark.range(10_000).select(F.col("id").alias("a"), (F.col("id") % 3).alias("b"))
    bins = B.binning(df, ["a", "b"])
    assert len(bins.cuts[0]) == B.BINS - 1 and bins.cuts[1] == [0.5, 1.5]
    sizes = bins.place(df).groupBy("_bin_0").count().agg(F.min("count"), F.max("count")).first()
    assert sizes[0] > 250 and sizes[1] < 400
