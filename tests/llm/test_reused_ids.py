"""Classes whose ids are reused or missing."""

from __future__ import annotations

import collections

import numpy as np

from shelfcast.llm import near_dedup, queries


def _words(seed, n):
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(list("abcdeilmnorstu"), 7)) for _ in range(n)]


def test_reused_and_missing_ids_do_not_merge_or_split_classes(spark):
    one, two, three = (_words(s, 80) for s in (1, 2, 3))
    near = [*three[:40], "changed", *three[41:]]
    rows = [(5, " ".join(one)), (5, " ".join(two)), (8, " ".join(two)), (None, " ".join(three)), (None, " ".join(near))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [r["text"] for r in near_dedup.keep_one(df).collect()]
    assert len(kept) == 3 and {" ".join(one), " ".join(two)} < set(kept)
    found = near_dedup.near_duplicates(df).collect()
    assert len({r["class_key"] for r in found}) == 3


def test_registered_query_tells_classes_apart(spark, tmp_path):
    one, two = (" ".join(_words(s, 80)) for s in (1, 2))
    rows = [(5, one), (5, two), (8, two), (None, one), (None, None), (None, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op4_near_duplicates(spark, str(tmp_path)).collect()
    assert len(found) == len(rows)
    assert sorted(collections.Counter(r["class_key"] for r in found).values()) == [2, 2, 2]
