"""Quality rules as a cascade that stops at a document's first failed rule, cheap and selective rules first.

Every rule is a condition on a document's text, its words, its lines that hold a word, and a few counts.
A document is kept if no rule rejects it, so the order of the rules never changes a verdict; it only decides
how much work a rejected document costs.  ``plan`` measures on a bounded sample how long each rule takes and
how many rows it rejects, and orders the rules by rejections per second; ``judge`` evaluates them in that
order inside one CASE expression, which Spark leaves at its first true branch.

All of this is DataFrame expressions: no Python runs on the executors, and no row is shuffled.

Edge cases: a null text has no words and no lines, all its counts are 0, and it fails the base rule; so does
an empty text.  Rows with the same id or text are judged one by one.  A table without rows gives no rows and
leaves the rules in their stated order.  Columns beside id and text are not read, whatever their names.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import about, texts
from shelfcast.sources.scratch import stored

BLANK = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
SAMPLE_ROWS = 2_000  # rows that costs and selectivities are measured on; no verdict depends on them
MEASURES = 2  # the faster of so many runs counts
LEAST_WORDS = 50
REPEATED_PERCENT = 50  # most words in repeated windows of three
LONGEST_WORD = 1_000  # code points
FEW = 32  # texts with no more repeated windows are searched for these alone


@dataclass(frozen=True)
class Rule:
    """A name and a condition that rejects; it may use text, words, lines and the base counts."""

    name: str
    rejects: Callable[[], Column]


def _matches(pattern: str) -> Column:
    return F.regexp_count("text", F.lit(pattern))


def _kept_chars(others: str) -> Column:
    """Code points of the text that are left when ``others`` is taken out."""
    return F.length(F.regexp_replace("text", others, ""))


def _some_lines(pattern: str) -> Column:
    return F.size(F.filter("lines", lambda line: line.rlike(pattern)))


RULES = (
    Rule("few_words", lambda: F.col("n_words") < LEAST_WORDS),
    Rule("repeated_words", lambda: 100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words")),
    Rule("word_length", lambda: (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words"))),
    Rule("symbols", lambda: 10 * F.col("n_symbols") > F.col("n_words")),
    Rule("duplicate_lines", lambda: 10 * F.col("n_dup_lines") > 3 * F.size("lines")),
    Rule("shouting", lambda: 10 * _kept_chars(r"\P{Lu}+") > 3 * _kept_chars(r"\P{L}+")),
    Rule("words_without_letter", lambda: 5 * F.size(F.filter("words", lambda w: ~w.rlike(r"\p{L}"))) > F.size("words")),
    Rule("exclamations", lambda: 10 * _matches("[!?]{2,}") > F.col("n_words")),
    Rule("bullets", lambda: 10 * _some_lines(r"^[\x20\x09]*[-*•]") > 9 * F.size("lines")),
    Rule("ellipses", lambda: 10 * _some_lines(r"(\.\.\.|…)[\x20\x09\r]*$") > 3 * F.size("lines")),
    Rule("markup", lambda: 20 * _matches("</?[A-Za-z][^<>]*>") > F.col("n_words")),
    Rule("endless_word", lambda: F.exists("words", lambda w: F.length(w) > LONGEST_WORD)),
)


def _bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once: a lambda that names a long array from outside may build it anew
    for every element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _windows(words: Column) -> Column:
    """A hash of each window of three words, in order."""

    def hashes(ws: Column) -> Column:
        heads = F.slice(ws, F.lit(1), F.greatest(F.size(ws) - 2, F.lit(0)))
        return F.transform(heads, lambda w, i: F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2)))

    return _bound(words, hashes)


def _found_again(windows: Column) -> Column:
    """The hashes that occur twice or more."""
    return _bound(F.sort_array(windows), lambda s: F.filter(s, lambda x, k: F.coalesce(x == F.get(s, k - 1), F.lit(False))))


def _repeat_words(words: Column, windows: Column, again: Column) -> Column:
    """Words that lie in windows of three which the text holds twice or more.

    Most texts repeat few windows or none: then only those whose hash is found again are looked at, else all.
    These are sorted by their words, so equal ones are neighbours; each position in a group of two or more
    covers the words from there that the position before has not covered yet.
    """

    def chosen(v: Column) -> Column:
        every = F.sequence(F.lit(0), F.size(v["windows"]) - 1)
        few = F.filter(every, lambda i: F.array_contains(v["again"], F.get(v["windows"], i)))
        places = F.when(F.size(v["again"]) <= FEW, few).otherwise(every)

        def window(i: Column) -> Column:
            a, b, c = (F.get(v["words"], i + k) for k in range(3))
            return F.struct(a.alias("a"), b.alias("b"), c.alias("c"), i.alias("i"))

        return F.sort_array(F.transform(places, window))

    def same(x: Column, y: Column) -> Column:
        return F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))

    def repeated(s: Column) -> Column:
        found = F.filter(s, lambda x, k: same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1)))
        return F.sort_array(F.transform(found, lambda x: x["i"]))

    whole = F.struct(words.alias("words"), windows.alias("windows"), again.alias("again"))
    covered = F.aggregate(
        _bound(_bound(whole, chosen), repeated),
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    return F.when(F.size(again) > 0, covered).otherwise(F.lit(0).cast("long"))


def with_counts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, words, lines with a word, and the base counts of every whole text."""
    split = texts(documents, id_col, text_col).withColumns(
        {
            "words": F.array_remove(F.split("text", BLANK), ""),
            "lines": F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")),
        }
    )
    windowed = split.withColumn("_windows", _windows(F.col("words")))
    counted = windowed.withColumn("_again", _found_again(F.col("_windows"))).withColumns(
        {
            "n_words": F.size("words").cast("long"),
            "word_chars": F.length(F.array_join("words", "")).cast("long"),
            "n_symbols": _matches(SYMBOL).cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            "n_repeat_words": _repeat_words(F.col("words"), F.col("_windows"), F.col("_again")),
        }
    )
    return counted.drop("_windows", "_again")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))


def plan(counted: DataFrame, rules: Sequence[Rule] = RULES, rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """The rules in the order of evaluation, each with its seconds and its share of rejected rows on the sample.

    A rule's cost is the time of a job that evaluates it on the stored sample, less that of a job that only
    reads the same columns.  Rules that reject most per second come first; ties keep the stated order.
    """
    sample = stored(about(counted, rows, "text"), "rule-sample")

    def timed(rejects: Column) -> tuple[float, int, int]:
        best, seen = float("inf"), None
        for _ in range(MEASURES):
            begin = time.perf_counter()
            seen = sample.agg(F.count_if(rejects), F.count(F.lit(1)), F.max(F.length("text")), F.max(F.size("words"))).first()
            best = min(best, time.perf_counter() - begin)
        return best, seen[0], seen[1]

    idle = timed(F.lit(False))[0]
    told = []
    for rule in rules:
        seconds, rejected, n = timed(rule.rejects())
        told.append((rule, max(seconds - idle, 1e-3), rejected / n if n else 0.0))
    return sorted(told, key=lambda x: -x[2] / x[1])


def verdict(rules: Sequence[Rule]) -> Column:
    """False at the first rule that rejects, true if none does; a row that has failed the base rule asks none."""
    out = F.when(base_failed(), F.lit(False))
    for rule in rules:
        out = out.when(rule.rejects(), F.lit(False))
    return out.otherwise(F.lit(True))


def judge(
    documents: DataFrame,
    rules: Sequence[Rule] = RULES,
    sample_rows: int = SAMPLE_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, text, words, lines, the base counts, ``base_failed`` and ``kept``, one row per document."""
    counted = with_counts(documents, id_col, text_col)
    ordered = [rule for rule, _, _ in plan(counted, rules, sample_rows)]
    return counted.withColumns({"base_failed": base_failed(), "kept": verdict(ordered)})
