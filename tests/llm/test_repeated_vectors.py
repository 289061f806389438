"""Ids that stand over several vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from shelfcast.llm import ann


def test_repeated_ids_count_with_their_highest_score(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(60, 8))
    ids = [i % 45 for i in range(60)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, vectors)], "vec_id long, embedding array<double>")
    best = {}
    for q, a in zip(ids, vectors):
        for i, b in zip(ids, vectors):
            if q % 20 == 0 and i != q:
                best[q, i] = max(best.get((q, i), -np.inf), float(a @ b))
    want = {}
    for q in (0, 20, 40):
        own = sorted((-s, i) for (p, i), s in best.items() if p == q)[:20]
        want[q] = [i for _, i in own]
    for frame in (df, df.repartition(7)):
        got = ann.nearest(frame, F.col("vec_id") % 20 == 0).collect()
        for q, ids_ in want.items():
            own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
            assert [r["vec_id"] for r in own] == ids_
            assert np.allclose([r["score"] for r in own], [best[q, i] for i in ids_])
