"""The local smoother on scatters of many blocks, against sums over all pairs."""

from __future__ import annotations

import numpy as np
import pytest

import shelfcast.operators.ordered as ordered
import shelfcast.operators.smooth as smooth


def plain(x, y, frac, iters):
    """The same by weights of every point against every other; short scatters only."""
    near = min(max(int(frac * len(x) + 1e-10), 1), len(x)) - 1
    gap = x[None, :] - x[:, None]
    far = np.abs(gap)
    h = np.partition(far, near, axis=1)[:, near][:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        tricube = np.where(h > 0, np.clip(1 - (far / h) ** 3, 0, None) ** 3, far == 0)
    robust, fit = np.ones(len(x)), np.zeros(len(x))
    for step in range(iters + 1):
        w = tricube * robust
        mass = w.sum(1)
        with np.errstate(divide="ignore", invalid="ignore"):
            mx, my = (w * gap).sum(1) / mass, (w * y).sum(1) / mass
            off = gap - mx[:, None]
            var = (w * off * off).sum(1)
            new = my - np.where(var > 1e-13 * (w * gap * gap).sum(1), (w * off * y).sum(1) / var, 0) * mx
        fit = np.where(mass > 0, new, fit)
        limit = 6 * np.median(np.abs(y - fit))
        if limit <= 0:
            break
        robust = np.clip(1 - (np.abs(y - fit) / limit) ** 2, 0, None) ** 2
    return fit


def scatter(kind, n):
    rng = np.random.default_rng(len(kind))
    x = {
        "normal": rng.normal(size=n),
        "long tails": rng.lognormal(0, 3, n),
        "hot value": np.where(rng.random(n) < 0.4, 0.0, rng.normal(size=n)),
        "whole numbers": rng.integers(0, 40, n).astype(float),
        "one value": np.full(n, 3.0),
        "far off": 1e6 + rng.random(n),
    }[kind]
    return x, np.sin(x - np.median(x)) + rng.normal(size=n) * 0.3


KINDS = ["normal", "long tails", "hot value", "whole numbers", "one value", "far off"]


@pytest.mark.parametrize("frac,iters", [(2 / 3, 0), (0.1, 2)])
def test_many_blocks_equal_sums_over_all_pairs(spark, monkeypatch, frac, iters):
    monkeypatch.setattr(smooth, "BLOCK", 16)
    monkeypatch.setattr(smooth, "FAN", 4)
    monkeypatch.setattr(ordered, "LEAST_ROWS", 300)  # so that the orders themselves are cut too
    rows, want = [], {}
    for kind in KINDS:
        x, y = scatter(kind, 700)
        rows += [(kind, float(a), float(b)) for a, b in zip(x, y)]
        want[kind] = (x, y, plain(x, y, frac, iters))
    df = spark.createDataFrame([*rows, (None, 1.0, 1.0), ("normal", None, 1.0), ("normal", 1.0, None)], "g string, x double, y double")
    got = smooth.lowess(df, "x", "y", ["g"], frac, iters).toPandas()
    assert len(got) == len(rows)
    for kind, (x, y, fit) in want.items():
        own = got[got.g == kind].sort_values(["x", "y"])
        assert own.smooth.to_numpy() == pytest.approx(fit[np.lexsort((y, x))], abs=1e-6), kind


def test_no_key_few_points_and_none(spark):
    schema = "x int, y int, smooth_not string"
    assert smooth.lowess(spark.createDataFrame([], schema), "x", "y").count() == 0
    one = smooth.lowess(spark.createDataFrame([(1, 5, "a")], schema), "x", "y").collect()
    assert [tuple(r) for r in one] == [(1.0, 5.0, 5.0)]
    line = spark.createDataFrame([(i, 2 * i, "a") for i in range(9)] * 2, schema)
    got = smooth.lowess(line, "x", "y", frac=0.9).collect()
    assert len(got) == 18 and all(r["smooth"] == pytest.approx(2 * r["x"], abs=1e-9) for r in got)
