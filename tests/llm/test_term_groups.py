"""Only near copies share a group of terms."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from shelfcast.llm import toxicity


def _words(seed, n):
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(list("abcdeilmnorstu"), 7)) for _ in range(n)]


def test_a_shared_word_does_not_merge_unrelated_texts():
    one, two = _words(4, 60), _words(5, 60)
    low = min(one + two, key=lambda w: toxicity.zlib.crc32(w.encode()))
    highest = max(one, key=lambda w: toxicity.zlib.crc32(w.encode()))
    near = [w for w in one if w != highest]
    texts = [" ".join([low, *ws]) for ws in (one, two, near)]
    batch = pa.RecordBatch.from_arrays([pa.array([0, 1, 0], pa.int32()), pa.array(texts)], names=["label", "text"])
    (out,) = toxicity.spread_terms(iter([batch]))
    groups = [r["grp"] for r in out.to_pylist() if r["term"] == low]
    assert groups[0] == groups[2] != groups[1]
