"""Correlations of many columns are taken in parts that Spark compiles."""

import pytest
from pyspark.sql import functions as F

from shelfcast.operators import profile as P

COLS = ["a", "b", "c", "d", "e", "f"]


def test_parts_give_every_pair(spark):
    mixed = [F.when(F.col("id") % (i + 3) > 0, F.pmod(F.xxhash64("id", F.lit(i)), F.lit(50)) + F.col("id")) for i in range(6)]
    df = spark.range(300).select(*[m.alias(c) for m, c in zip(mixed, COLS)])
    made = P.corr_matrix(df, COLS)
    plan = made._jdf.queryExecution().executedPlan().toString()
    sums = [line.count("partial_corr(") for line in plan.splitlines() if "partial_corr(" in line]
    assert sum(sums) == 21 and max(sums) <= P.COMPILED_PAIRS
    got = {(r["a"], r["b"]): r["corr"] for r in made.collect()}
    want = df.agg(*[F.corr(a, b).alias(a + b) for a in COLS for b in COLS]).first()
    assert got == pytest.approx({(a, b): want[a + b] for a in COLS for b in COLS}, rel=1e-9)
