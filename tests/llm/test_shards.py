"""Shards: equal texts together, weights, hot groups, and the placement against a plain loop."""

from __future__ import annotations

import collections
import zlib

import numpy as np
from pyspark.sql import functions as F

from shelfcast.llm import sharding


def _slots_gapless(got):
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(own) == list(range(len(own))) for own in by.values())


def test_equal_texts_share_a_shard(spark):
    pairs = [(i, f"text {i % 1000} " + "w " * (i % 1000 % 37)) for i in range(2000)]
    pairs += [(None, "no id"), (None, "no id"), (7, "twice"), (7, "twice"), (8, None), (9, ""), (10, None)]
    df = spark.createDataFrame([(*p, 1, "x") for p in pairs], "doc_id long, text string, size int, unit string")
    got = sharding.shard(df).collect()
    assert len(got) == len(pairs)
    _slots_gapless(got)
    want = collections.Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in pairs)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    shards = collections.defaultdict(set)
    for r in got:
        shards[r["size"], r["text_crc32"]].add(r["shard"])
    assert all(len(s) == 1 for s in shards.values())
    sizes = np.bincount([r["shard"] for r in got], [r["size"] for r in got], 24)
    assert np.ptp(sizes) < 0.1 * sizes.mean()


def test_given_table_keeps_groups_whole(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = sharding.shard(docs)
    share = got.agg(F.sum("size"), F.count("*"), F.sum("tokens")).first()
    groups = got.groupBy("text_crc32", "size").agg(
        F.countDistinct("shard").alias("shards"), F.count("*").alias("n"), F.sum("size").alias("b"), F.sum("tokens").alias("t")
    )
    split = groups.filter("shards > 1").collect()
    assert all(max(r["b"] / share[0], r["n"] / share[1], r["t"] / share[2]) > sharding.WHOLE / 24 for r in split)


def test_hot_group_without_ids_is_spread(spark):
    hot = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same").alias("text"))
    rest = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("a b "), F.col("id").cast("string")).alias("text"))
    got = sharding.shard(hot.union(rest)).collect()
    _slots_gapless(got)
    assert len({r["shard"] for r in got if r["doc_id"] is None}) == 24
    counts = collections.Counter(r["shard"] for r in got)
    assert max(counts.values()) - min(counts.values()) < 0.05 * len(got) / 24 + 2
    assert sharding.shard(rest.limit(0)).count() == 0


def _plain(weights, groups, shards):
    """The rules of ``place`` one comparison at a time."""
    total = [sum(w[k] for w in weights) or 1 for k in range(3)]
    share = [[w[k] / total[k] for k in range(3)] for w in weights]
    left = [[1 / shards] * 3 for _ in range(shards)]
    out = [None] * len(weights)

    every = list(range(shards))
    todo = []
    for g in range(max(groups) + 1):
        own = [c for c in range(len(weights)) if groups[c] == g]
        todo.append((0, g, own, [sum(share[c][k] for c in own) for k in range(3)]))
    while todo:
        todo.sort(key=lambda u: (-max(u[3]), u[0], u[1]))
        _, _, own, want = todo.pop(0)
        large = len(own) > 1 and max(want) > sharding.WHOLE / shards
        fits = [s for s in every if all(left[s][k] >= want[k] - 1e-12 for k in range(3 if large else 1))]
        if large and (max(want) > 1 / shards or not fits):
            todo += [(1, c, [c], share[c]) for c in own]
            continue
        if fits:
            best = max(fits, key=lambda s: (sum(left[s][k] * want[k] for k in range(3)), -s))
        else:
            best = max(every, key=lambda s: (left[s][0], -s))
        left[best] = [left[best][k] - want[k] for k in range(3)]
        for c in own:
            out[c] = best
    return out


def test_placement_is_the_plain_loop():
    rng = np.random.default_rng(3)
    for trial in range(20):
        groups = rng.integers(0, 40, 120)
        groups = np.unique(groups, return_inverse=True)[1]
        # Powers of two add up exactly, so ties are ties in both.
        weights = 2.0 ** rng.integers(0, 5 + trial % 3, (120, 3))
        weights[0] += 2.0 ** np.ceil(np.log2(weights.sum(axis=0))) - weights.sum(axis=0)
        got = sharding.place(weights, groups, 8)
        assert got.tolist() == _plain(weights.tolist(), groups.tolist(), 8)
