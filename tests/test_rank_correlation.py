"""Rank correlation with heavy ties."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfcast.operators import profile


@pytest.mark.parametrize("heavy", (1, 3, 1000))
def test_heavy_and_light_values(spark, monkeypatch, heavy):
    monkeypatch.setattr(profile, "HEAVY_VALUES", heavy)
    rng = np.random.default_rng(2)
    a = np.where(rng.random(6000) < 0.5, 7, rng.integers(0, 4000, 6000))
    pdf = pd.DataFrame({"a": a.astype(float), "b": np.round(a / 100 + rng.normal(0, 9, 6000)), "_c": 1})
    pdf.loc[::50, "a"] = np.nan
    got = profile.corr_spearman(spark.createDataFrame(pdf), "a", "b").first()["corr"]
    assert got == pytest.approx(pdf[["a", "b"]].dropna().corr(method="spearman").iloc[0, 1], abs=1e-12)


def test_constant_and_empty(spark):
    df = spark.range(10).select(F.lit(1).alias("a"), F.col("id").alias("b"))
    assert profile.corr_spearman(df, "a", "b").first()["corr"] is None
    assert profile.corr_spearman(df.limit(0), "a", "b").first()["corr"] is None


def test_every_row_of_a_hot_value_gets_its_rank(spark):
    df = spark.range(4000).select(F.when(F.col("id") % 2 == 0, -1).otherwise(F.col("id")).alias("a"), (F.col("id") * 7 % 4001).alias("b"))
    pairs = df.withColumn("_n", F.lit(1))
    ranks = profile._average_ranks(pairs, "a", [])
    joined = profile._with_ranks(pairs, ranks, "a", 4000)
    assert joined.filter("a = -1").count() == 2000 and joined.count() == 4000
    assert joined.filter("a = -1").select("_rank_a").distinct().first()[0] == 1000.5
