"""Keys of the neighbour search: recall against pairs looked at, and probes in the order of their sums."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast.llm import ann


def unit(n, d=64, seed=3):
    x = np.random.default_rng(seed).normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1)[:, None]


def test_keys_grow_with_the_band():
    assert [ann.axes_for(n) for n in (1, 32, 33, 8191, 8192, 2_097_151, 2_097_152, 600_000_000)] == [0, 0, 1, 1, 2, 2, 3, 4]


def test_probes_are_the_nearest_keys(monkeypatch):
    monkeypatch.setattr(ann, "TRIED", 16)
    x = ann.lifted(unit(5, 7), None)
    cell, last = ann.probed_keys(x, 2, 2, 20)
    one, two = ann._signed(x, 2, 0), ann._signed(x, 2, 1)
    for i in range(5):
        every = sorted((one[i, a] + two[i, b] for a, b in itertools.product(range(16), range(16))), reverse=True)
        assert len(set(zip(cell[i], last[i]))) == 20
        assert one[i, cell[i] - 2 * 16] + two[i, last[i]] == pytest.approx(every[:20])
    own = ann.own_keys(x, 2, 2)
    assert np.array_equal(own[0], cell[:, 0]) and np.array_equal(own[1], last[:, 0])


def test_recall_and_share_of_pairs_of_unit_vectors():
    x = unit(20_000)
    queries = np.arange(0, 20_000, 250)
    u, q = ann.lifted(x, 1 + 1e-12), ann.lifted(x[queries], None)
    axes = ann.axes_for(len(x))
    looked, pairs = np.zeros((len(q), len(x)), bool), 0
    for t in range(ann.TABLES):
        (cell, last), (cells, lasts) = ann.own_keys(u, t, axes), ann.probed_keys(q, t, axes, ann.probes_for(axes))
        for i in range(len(q)):
            hit = np.isin(cell * 256 + last, cells[i] * 256 + lasts[i])
            pairs, looked[i] = pairs + hit.sum(), looked[i] | hit
    score = x[queries] @ x.T
    score[np.arange(len(q)), queries] = -np.inf
    top = np.argsort(-score, axis=1)[:, :20]
    assert np.take_along_axis(looked, top, axis=1).mean() >= 0.9
    assert pairs <= 0.2 * looked.size


@pytest.mark.parametrize("n,least", [(500, 32), (2000, 1)])
def test_unit_vectors_through_the_operator(spark, monkeypatch, n, least):
    monkeypatch.setattr(ann, "LEAST", least)  # 1: two axes in a key
    x = unit(n, 32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    probes = 2000 if least == 1 else None
    got = ann.nearest(df, F.col("vec_id") % 20 == 0, probes=probes).collect()
    want = {(r["query_id"], r["vec_id"]): r["score"] for r in ann.nearest_exact(df, F.col("vec_id") % 20 == 0).collect()}
    found = {(r["query_id"], r["vec_id"]): r["score"] for r in got}
    assert len(got) == len(want) == 20 * n // 20
    assert len(want.keys() & found.keys()) >= 0.9 * len(want)
    assert all(found[p] == want[p] for p in want.keys() & found.keys())
