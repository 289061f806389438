"""Bootstrap bands over single rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfcast.operators import stats


def test_width_is_that_of_theory_on_skewed_rows(spark):
    rng = np.random.default_rng(5)
    values = np.round(np.exp(rng.normal(0, 1, 5000)), 2)
    rows = [("a", 1, float(v)) for v in values] + [("b", 1, float(v)) for v in values[:2000]]
    df = spark.createDataFrame(rows, "k string, g int, v double")
    got = {r["k"]: r for r in stats.mean_ci(df, "k", "v", ["g"], reps=4000).collect()}
    for k, own in (("a", values), ("b", values[:2000])):
        assert got[k]["mean"] == pytest.approx(own.mean())
        width = 2 * 1.96 * own.std(ddof=1) / len(own) ** 0.5
        assert (got[k]["high"] - got[k]["low"]) / width == pytest.approx(1, abs=0.05)
        assert got[k]["low"] < own.mean() < got[k]["high"]


def test_counted_rows_are_drawn_as_single_rows(spark):
    """With two values the share of one is binomial; the rows are few cells but many draws."""
    df = spark.range(3000).select(F.lit("x").alias("k"), (F.col("id") % 10 == 0).cast("double").alias("v"))
    got = stats.mean_ci(df, "k", "v", reps=4000).first()
    assert (got["high"] - got["low"]) / (2 * 1.96 * (0.1 * 0.9 / 3000) ** 0.5) == pytest.approx(1, abs=0.05)


def test_band_does_not_depend_on_how_rows_lie(spark, monkeypatch):
    df = spark.range(3000).select((F.col("id") % 300).alias("k"), (F.col("id") * 37 % 101).cast("double").alias("v"))
    first = sorted(map(tuple, stats.mean_ci(df, "k", "v", reps=50).collect()))
    monkeypatch.setattr(stats, "HELD_GROUPS", 3)
    again = sorted(map(tuple, stats.mean_ci(df.repartition(13, "v"), "k", "v", reps=50).collect()))
    assert len(first) == 300 and np.allclose(first, again, rtol=1e-12)
    other = sorted(map(tuple, stats.mean_ci(df, "k", "v", reps=50, seed=1).collect()))
    assert not np.allclose(first, other)


def test_edge_rows(spark):
    rows = [("one", 4.0), ("same", 2.0), ("same", 2.0), ("null", None), (None, 1.0), ("nan", float("nan"))]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: tuple(r)[1:] for r in stats.mean_ci(df, "k", "v", reps=60).collect()}
    assert got == {"one": (4.0, 4.0, 4.0), "same": (2.0, 2.0, 2.0)}
    assert stats.mean_ci(df.limit(0), "k", "v", reps=60).count() == 0


def test_a_block_is_drawn_together(monkeypatch):
    """One generator a block, also where batches cut it, in place of one a value."""
    rows = pd.DataFrame({"k": ["a"] * 300 + ["b"] * 50, "_v": np.arange(350.0), "_c": 1, "_h": [7] * 200 + [-8] * 100 + [9] * 50})
    calls, plain = [], stats._drawn
    monkeypatch.setattr(stats, "_drawn", lambda v, *rest: calls.append(len(v)) or plain(v, *rest))
    run = stats._replicates(["k"], 40)
    cut, whole = (pd.concat(run(iter(b))) for b in ([rows[:150], rows[150:260], rows[260:260], rows[260:]], [rows]))
    assert calls == [200, 100, 50] * 2 and cut["k"].tolist() == ["a", "b"]
    assert all(np.array_equal(x, y) for c in ("_s", "_n") for x, y in zip(cut[c], whole[c]))


def test_draws_have_the_moments_of_single_rows():
    values, rows = np.array([1.0, 5.0, -3.0, 10.0, 2.5]), np.array([1, 3, 15, 16, 400])
    total, times = stats._drawn(values, rows, 40_000, np.random.default_rng(2))
    assert total.mean() == pytest.approx((values * rows).sum(), rel=0.005)
    assert total.var() == pytest.approx((values**2 * rows).sum(), rel=0.04)
    assert times.mean() == pytest.approx(rows.sum(), rel=0.005) and times.var() == pytest.approx(rows.sum(), rel=0.04)
    assert np.cov(total, times)[0, 1] == pytest.approx((values * rows).sum(), rel=0.06)
    few = stats._drawn(values[:1], rows[:1], 1000, np.random.default_rng(3))
    assert (few[1] == 0).any() and np.array_equal(few[0], few[1])
