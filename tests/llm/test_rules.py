"""The rule cascade against brute force, and its order against its measures."""

from __future__ import annotations

import collections
import re

import pytest
from pyspark.sql import functions as F

from shelfcast.llm import rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PROSE = " ".join(f"word{i % 97}x{i}" for i in range(80))
TEXTS = [
    None,
    "",
    " \t\n\x0b\x0c\r ",
    "one two",
    "a b c a b c a",
    "x x x x x",
    "l1 w\n\nl1 w\n \nl1 w",
    "été là #1 $$$ <b> | 5%",
    PROSE,
    PROSE + "\n" + PROSE,
    PROSE.upper(),
    " ".join(w + "$$$" for w in PROSE.split()),
    " ".join(w + "!!" for w in PROSE.split()),
    " | ".join(PROSE.split()),
    "\n".join("- " + w for w in PROSE.split()),
    "\n".join(w + " ..." for w in PROSE.split()),
    PROSE + " " + "y" * 1500,
    " ".join(f"w{i % 5000}" for i in range(30_000)),
    " ".join(f"t{i % 7}" for i in range(100)),
    " ".join(["the same passage here"] * 3 + [f"u{i}" for i in range(60)]),
]


def brute(text: str | None) -> tuple:
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    at = collections.defaultdict(list)
    for i in range(len(words) - 2):
        at[tuple(words[i : i + 3])].append(i)
    again = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(3)}
    symbols = sum(c in "#*$%&|<>" for c in text)
    failed = len(words) < 50 or 100 * len(again) > 50 * len(words)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(again), failed


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


@pytest.fixture(scope="module")
def judged(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate(TEXTS)] + [(None, PROSE, "x", "y"), (8, PROSE, "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, words string, kept string")
    return rules.judge(docs, sample_rows=50).collect()


def test_counts_match_brute_force(judged):
    assert len(judged) == len(TEXTS) + 2
    for r in judged:
        text = PROSE if r["doc_id"] is None else TEXTS[r["doc_id"]]
        assert tuple(r[c] for c in COUNTS) == brute(text), r["doc_id"]


def test_clean_text_is_kept_and_each_kind_of_junk_goes(judged):
    kept = {r["doc_id"] for r in judged if r["kept"]}
    assert kept == {None, 8, 19}
    assert not any(r["kept"] and r["base_failed"] for r in judged)


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert rules.judge(docs).count() == 0
    assert [r for r, _, _ in rules.plan(rules.with_counts(docs))] == list(rules.RULES)


def test_rules_are_ordered_by_rejections_per_second(spark):
    rows = [(i, PROSE + f" e{i}" if i % 4 else "short") for i in range(40)]
    counted = rules.with_counts(spark.createDataFrame(rows, "doc_id long, text string"))
    slow = rules.Rule("slow", lambda: F.regexp_replace(F.repeat("text", 300), r"(\w+)x(\w+)", "$2$1").startswith("?") | (F.col("n_words") < 50))
    never = rules.Rule("never", lambda: F.lit(False))
    quick = rules.RULES[0]
    told = rules.plan(counted, [never, slow, quick])
    assert [r.name for r, _, _ in told] == [quick.name, "slow", "never"]
    assert {r.name: share for r, _, share in told} == {quick.name: 0.25, "slow": 0.25, "never": 0.0}


def test_only_expressions_on_the_main_path(spark, capsys):
    docs = spark.createDataFrame([(1, PROSE)], "doc_id long, text string")
    rules.judge(docs).explain()
    plan = capsys.readouterr().out
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "Exchange"))
