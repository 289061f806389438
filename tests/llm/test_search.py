"""Ranked search against brute force, with copies, ties and few documents; and that blocks are skipped."""

from __future__ import annotations

import collections
import math
import re

import numpy as np
import pytest

from shelfcast.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _terms(text: str | None) -> list[str]:
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return TERM.findall(lower)


def brute(docs: list[tuple], items: list[tuple], k: int = search.K) -> list[tuple]:
    found = [(d, collections.Counter(_terms(t))) for d, t in docs]
    found = [(d, c) for d, c in found if c]
    total, n_docs = sum(sum(c.values()) for _, c in found), len(found)
    df = collections.Counter(t for _, c in found for t in c)
    rows = []
    for item, text in dict.fromkeys(items):
        scored = []
        for at, (d, c) in enumerate(found):
            n = sum(c.values())
            m = 100 - 25 + (25 * n * n_docs) // total
            s = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
                for t in _terms(text)
                if t in c
            )
            if s > 0:
                scored.append((-s, d is None, d or 0, at, d))
        rows += [(item, i + 1, x[4], -x[0]) for i, x in enumerate(sorted(scored)[:k])]
    return rows


def _key(row):
    return tuple((v is None, v or 0) for v in row)


def check(spark, docs, items, extra=(), **more):
    rows = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, row string, score int")
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in search.rank(rows.repartition(5), asked, **more).collect()]
    assert sorted(got, key=_key) == sorted(brute(docs, items, **more), key=_key)


def _corpus(seed: int, n: int) -> list[tuple]:
    rng = np.random.default_rng(seed)
    vocabulary = np.array([f"w{i}" for i in range(3000)])
    topics = [rng.permutation(3000)[:200] for _ in range(8)]
    rows = []
    for i in range(n):
        common = np.minimum(rng.zipf(1.3, rng.integers(5, 60)), 300) - 1
        own = rng.choice(topics[i % 8], rng.integers(5, 60))
        rows.append((i, " ".join(vocabulary[np.r_[common, own]])))
    return rows


@pytest.fixture(scope="module")
def corpus():
    return _corpus(1, 700)


def test_matches_brute_force(spark, corpus, monkeypatch):
    """Copies, ties, edge texts and a long document; segments and blocks small enough that there are many."""
    monkeypatch.setattr(search, "SEGMENT_DOCS", 64)
    monkeypatch.setattr(search, "BLOCK_DOCS", 4)
    docs = corpus + [(1000 + i, corpus[3][1]) for i in range(90)] + [(5, "another text under an id that is taken w1 w2")]
    docs += [(None, corpus[4][1]), (None, None), (2000, None), (2001, ""), (2002, "!!! ..."), (2003, "É é Straße w1-w2_W1 w\x7f3")]
    docs += [(2004, " ".join(t for _, t in corpus[:400]))]
    items = [(i, corpus[i * 31][1]) for i in range(12)] + [(12, corpus[3][1].upper()), (13, "É Straße W1"), (14, None), (15, "")]
    items += [(16, "never seen"), (0, corpus[0][1]), (0, "w7 w7 w9"), (None, "w3 w250")]
    check(spark, docs, items)


def test_fewer_documents_than_asked_for(spark):
    check(spark, [(1, "a b c"), (2, "a"), (3, "zz")], [(1, "a b"), (2, "c c a")])
    check(spark, [(1, "a b c"), (2, "a")], [(1, "a b")], k=1)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert search.rank(docs.limit(0), items).count() == 0
    assert search.rank(docs, items.limit(0)).count() == 0
    assert search.rank(docs.limit(0), items).columns == ["item_id", "rank", "doc_id", "score"]


def test_items_are_worked_on_in_blocks(spark, corpus, monkeypatch):
    monkeypatch.setattr(search, "ITEM_BYTES", 500)
    check(spark, corpus[:120], [(i, corpus[i * 7][1]) for i in range(6)])


def test_blocks_below_the_threshold_are_skipped(spark, corpus):
    rows = spark.createDataFrame(corpus, "doc_id long, text string")
    asked = next(search.asked_items(rows.limit(0).union(spark.createDataFrame([corpus[9]], rows.schema))))
    counted = search._counted(rows, asked.vocabulary)
    n, length = counted.count(), counted.agg({"n": "sum"}).first()[0]
    weights = np.full(len(asked.vocabulary), 3000, np.int64)
    told = search.Weighed(asked.terms, [weights[t] for t in asked.terms], np.zeros(1, np.int64), len(weights))
    vectors = search.build_vectors(counted, weights, n, length)
    every = search.build_blocks(vectors, told)
    told.least = search._first_thresholds(counted, told, n, length, 5)
    assert told.least[0] > 0
    few = search.build_blocks(vectors, told)
    assert 0 < few.count() < every.count()
    a = search.search_segments(vectors, every, told, 5).collect()
    b = search.search_segments(vectors, few, told, 5).collect()
    top = lambda rows: sorted((-r["score"], r["doc_id"]) for r in rows)[:5]
    assert top(a) == top(b) and len(b) < len(corpus)
