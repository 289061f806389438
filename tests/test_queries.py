"""Every query against its SQL, and the ones without SQL against what must hold."""

import pytest
from checker import difference, duck_rows, spark_rows

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, sf_dir, name):
    note = difference(spark_rows(QUERIES[name](spark, sf_dir)), duck_rows(duck, SQL[name]))
    assert note is None, note


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_bootstrap_band_has_the_expected_width(spark, sf_dir):
    """A 95% band is about 2 * 1.96 standard errors wide."""
    from pyspark.sql import functions as F

    from shelfcast.operators.stats import mean_ci
    from shelfcast.sources import roles

    fact = roles.sales(spark, sf_dir).withColumn("x", F.lit(1))
    row = mean_ci(fact, "x", "sales", reps=400).first()
    stats = fact.agg(F.avg("sales"), F.stddev_samp("sales"), F.count("sales")).first()
    error = stats[1] / stats[2] ** 0.5
    assert row["mean"] == pytest.approx(stats[0])
    assert row["low"] < stats[0] < row["high"]
    assert (row["high"] - row["low"]) / (2 * 1.96 * error) == pytest.approx(1, abs=0.2)
    again = mean_ci(fact.repartition(13), "x", "sales", reps=400).first()
    assert list(again) == pytest.approx(list(row))


def test_hybrid_improves_on_its_first_stage(spark, sf_dir):
    scores = {r["is_test"]: r for r in QUERIES["q11_hybrid_scores"](spark, sf_dir).collect()}
    assert scores[False]["rmse"] <= scores[False]["rmse_stage_1"]
    assert scores[True]["n"] > 0


def test_boosted_trees_beat_the_line_on_a_step(spark):
    from pyspark.sql import functions as F

    from shelfcast.operators import evaluate as K
    from shelfcast.operators import forecast as M

    rows = spark.range(400).select(F.col("id"), (F.col("id") % 7).alias("d")).withColumn(
        "sales", F.when(F.col("d").isin(2, 5), 100.0).otherwise(10.0) + F.col("id") / 100
    )
    line = M.tabular_linear(rows, ["id", "d"]).transform(M.assemble(rows, ["id", "d"]))
    trees = M.tabular_boosted(rows, ["id", "d"], rounds=5, depth=3).transform(M.assemble(rows, ["id", "d"]))
    score = [df.agg(K.rmse("sales", "predicted")).first()[0] for df in (line, trees)]
    assert score[1] < score[0]


def test_boosted_folds_cover_all_rows(spark):
    from pyspark.sql import functions as F

    from shelfcast.operators import evaluate as K
    from shelfcast.operators import forecast as M

    rows = spark.range(100).withColumn("sales", F.col("id") * 2.0)
    folds = K.assign_folds(rows, "id", 3)
    out = M.cv_boosted(folds, 3, ["id"], rounds=2, depth=2).collect()
    assert sum(r["n"] for r in out) == 100 and {r["fold"] for r in out} == {0, 1, 2}


def test_submissions_are_not_negative(spark, sf_dir):
    out = QUERIES["q12_tabular_boosted_submission"](spark, sf_dir)
    assert out.filter("sales < 0 OR sales IS NULL").count() == 0 and out.count() > 0
