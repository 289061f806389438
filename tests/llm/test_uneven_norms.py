"""Neighbours where norms differ much, and where there are few candidates."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast.llm import ann


def _recall(spark, x, every):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got, want = (f(df, F.col("vec_id") % every == 0).collect() for f in (ann.nearest, ann.nearest_exact))
    pairs = lambda rs: {(r["query_id"], r["vec_id"]) for r in rs}
    return len(pairs(got) & pairs(want)) / len(pairs(want)), len(got), len(want)


@pytest.mark.parametrize("kind", ["lognormal", "one long"])
def test_recall_with_uneven_norms(spark, kind):
    rng = np.random.default_rng(21)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    if kind == "lognormal":
        x *= rng.lognormal(0, 0.7, (4000, 1))
    else:
        x[7] *= 100
    share, got, want = _recall(spark, x, 40)
    assert share >= 0.9 and got == want


def test_few_candidates_are_all_returned(spark):
    x = np.random.default_rng(22).normal(size=(15, 64))
    share, got, want = _recall(spark, x, 1)
    assert share == 1 and got == want == 15 * 14
