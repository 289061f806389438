"""Collocations against brute force, for shards, chunks and bit sets of any size."""

from __future__ import annotations

import collections
import re
import tracemalloc

import numpy as np
import pytest

from shelfcast.llm import collocations as C

LANGS = ["en", "de", None, "und"]


def _lower(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(rows: list[tuple], support: int, top: int = C.TOP) -> list[tuple]:
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", _lower(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, 5):
                f.update((lang, *words[i : i + size]) for i in range(len(words) - size + 1))
    out = collections.defaultdict(list)
    held = {p: c for p, c in f.items() if len(p) > 2 and c >= support}
    around = collections.Counter()
    for (lang, *words), c in held.items():
        for size in range(2, len(words)):
            for i in range(len(words) - size + 1):
                key = (lang, *words[i : i + size])
                around[key] = max(around[key], c)
    for (lang, *words), a in held.items():
        if 100 * around[(lang, *words)] >= 80 * a:
            continue
        cuts = [(f[(lang, *words[:k])], f[(lang, *words[k:])]) for k in range(1, len(words))]
        score, k = min((2_000_000 * a // (x + y), k) for k, (x, y) in enumerate(cuts))
        out[lang].append((-score, -a, " ".join(words).encode(), *cuts[k]))
    rows = []
    for lang, found in out.items():
        for i, (score, a, phrase, x, y) in enumerate(sorted(found)[:top]):
            rows.append((lang, i + 1, phrase.decode(), -a, x, y, n[lang], -score))
    return sorted(rows)


def _corpus(seed: int, docs: int) -> list[tuple]:
    rng = np.random.default_rng(seed)
    words = ["the", "The", "of", "São", "são", "x1", "naïve", "\x1c", "a-b", "…"] + [f"w{i}" for i in range(40)]
    marks = [" ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", "; ", "\x0b", "!?"]
    fixed = ["one fixed phrase of seven words here", "New York City", "NEW YORK city hall"]
    rows = []
    for i in range(docs):
        parts = []
        for _ in range(int(rng.integers(0, 60))):
            parts.append(fixed[rng.integers(3)] if rng.random() < 0.1 else words[min(int(rng.zipf(1.4)), len(words)) - 1])
            parts.append(marks[rng.integers(len(marks))])
        rows.append((LANGS[i % 4], "".join(parts)))
    return rows


def _got(spark, rows, **more):
    docs = spark.createDataFrame([(lang, t, 1, "x") for lang, t in rows], "lang string, text string, n long, phrase string")
    return sorted(tuple(r) for r in C.collocations(docs.repartition(7), **more).collect())


@pytest.fixture(scope="module")
def corpus():
    extra = [("en", None), (None, ""), ("de", ". , ;\n"), ("en", "long " * 5000), ("xx", "only one text here"), ("yy", "one"), ("zz", ""), ("en", "New York City")]
    return _corpus(5, 300) + extra + [("de", "the same text in many copies, all of it")] * 60


def test_matches_brute_force(spark, corpus):
    want = brute(corpus, 30)
    assert len(want) > 20 and {r[0] for r in want} == {"en", "de", "und"}
    assert _got(spark, corpus) == want


def test_ranks_stop_at_the_limit(spark, corpus):
    assert _got(spark, corpus, support=5, top=7) == brute(corpus, 5, 7)


def test_short_stretches_and_a_crowded_bit_set_change_nothing(spark, corpus, monkeypatch):
    monkeypatch.setattr(C, "CHUNK_WORDS", 100)
    monkeypatch.setattr(C, "_CHARS", 50)
    monkeypatch.setattr(C, "SHARDS", 3)
    monkeypatch.setattr(C, "MOST_BITS", 64)
    assert _got(spark, corpus, support=12) == brute(corpus, 12)


def test_a_set_has_all_its_phrases(spark):
    phrases = [("en", "a"), ("en", "a b"), ("de", "b c d e"), ("de", "é")]
    found = C.found_set(spark.createDataFrame(phrases, "lang string, phrase string"))
    for lang, phrase in [*phrases, ("en", "b c d e"), ("de", "a b")]:
        numbers = C._Numbers()
        chunk = C._Chunk(lang, numbers, C.numbered([phrase], numbers))
        n = len(phrase.split())
        assert chunk.known(found, (n,))[n][0] == ((lang, phrase) in phrases)


def test_empty_table(spark):
    assert _got(spark, []) == []


def test_hashing_holds_one_block_at_a_time(monkeypatch):
    """What is found does not depend on the blocks, and the hashes of a chunk are never held whole."""
    rng = np.random.default_rng(3)
    numbers = C._Numbers()
    stream = C.numbered(["".join(f"w{i}{'. ' if i % 7 == 0 else ' '}" for i in rng.integers(0, 60, 200_000))], numbers)
    chunk = C._Chunk("en", numbers, stream)
    found = C.Found(rng.integers(0, 2**63, 1 << 10, dtype=np.uint64))
    monkeypatch.setattr(C, "_PLACES", len(stream))
    whole = chunk.known(found, (1, 2, 3, 4))
    monkeypatch.setattr(C, "_PLACES", 1_001)
    tracemalloc.start()
    blocks = chunk.known(found, (1, 2, 3, 4))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all(0 < whole[n].sum() < len(stream) and (whole[n] == blocks[n]).all() for n in whole)
    assert peak < 8 * len(stream)  # one hash for each place
