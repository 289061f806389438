"""Benchmark passages in documents, also with other numbers, names or units.

A text becomes a row of template words: lower-case words, with a placeholder for a number, a name (a
capitalised word within a sentence) or a unit after a number.  Windows of ``WINDOW`` template words are
hash-joined between documents and benchmark items.  A document holds an item where enough windows match
at one offset, and where the slots of the matched passage are filled consistently: one value of the item
always stands for one value in the document.  DataFrame functions only.

Windows with fewer than ``LITERALS`` words that are not placeholders say nothing and are neither matched nor
asked for.  An item that is left without windows, or is shorter than one, must be found whole; with fewer than
``LITERALS`` such words in all, only its verbatim copies count.

Edge cases: null texts and null item texts are empty and match nothing; repeated rows give one match; empty
tables give an empty result.  Columns beside id and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import texts
from shelfcast.sources.scratch import stored

WINDOW = 8
LITERALS = 4
WINDOWS_NEEDED = 6  # 13 words in a row, or all windows of an item that has fewer
BROADCAST_WINDOWS = 1_000_000  # more windows of items than this are joined by a shuffle; a window takes some 32 bytes

# Placeholders (private-use characters) and units.
NAME, NUMBER, UNIT = "\ue000", "\ue001", "\ue002"
UNITS = "mm|cm|km|m|mg|kg|g|ml|l|s|ms|min|h|hours?|days?|weeks?|months?|years?|miles?|meters?|metres?|feet|inches|pounds?|dollars?|euros?|cents?|percent|degrees?"
NAME_AT = r"([\p{L}\p{N},;]\s)(\p{Lu}\p{Ll}+)"
NUMBER_AT = rf"(^|[^\p{{L}}\p{{N}}])(\p{{N}}+(?:[.,]\p{{N}}+)*)(?:\s?({UNITS})\b)?"
VALUE = rf"([{NAME}{NUMBER}{UNIT}])[\p{{L}}\p{{N}}]*(?:[.,]\p{{N}}+)*"
TOKEN = rf"[{NAME}{NUMBER}{UNIT}]|[\p{{L}}\p{{N}}]+"
VALUED = rf"[{NAME}{NUMBER}{UNIT}]\p{{L}}+|[{NAME}{NUMBER}{UNIT}]\p{{N}}+(?:[.,]\p{{N}}+)*|[\p{{L}}\p{{N}}]+"


def marked(text: Column) -> Column:
    """The text with a placeholder character before each number, name and unit."""
    plain = F.regexp_replace(text, f"[{NAME}{NUMBER}{UNIT}]", " ")
    for _ in range(2):  # a name right after another one is seen the second time
        plain = F.regexp_replace(plain, NAME_AT, f"$1{NAME}$2")
    numbers = F.regexp_replace(plain, NUMBER_AT, f"$1{NUMBER}$2 {UNIT}$3 ")
    return F.regexp_replace(numbers, rf"{UNIT} ", " ")


def template_words(text: Column) -> Column:
    """Lower-case words, with a bare placeholder for each slot."""
    bare = F.regexp_replace(F.lower(marked(text)), VALUE, "$1 ")
    return F.regexp_extract_all(bare, F.lit(TOKEN), F.lit(0))


def valued_words(text: Column) -> Column:
    """The same words, where a slot keeps its value after the placeholder."""
    return F.regexp_extract_all(F.lower(marked(text)), F.lit(VALUED), F.lit(0))


def is_slot(word: Column) -> Column:
    return F.substring(word, 1, 1).isin(NAME, NUMBER, UNIT)


def with_value(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def window_hashes(words: Column, n: int) -> Column:
    """A hash for each run of n words, in order; empty for a shorter text."""

    def rolled(codes: Column) -> Column:
        runs = F.transform(
            F.sequence(F.lit(0), F.size(codes) - n), lambda i: F.xxhash64(*[F.get(codes, i + k) for k in range(n)])
        )
        return F.when(F.size(codes) >= n, runs).otherwise(F.array().cast("array<bigint>"))

    return with_value(F.transform(words, lambda w: F.xxhash64(w)), rolled)


def matches(
    documents: DataFrame,
    benchmark: DataFrame,
    n: int = WINDOW,
    literals: int = LITERALS,
    needed: int = WINDOWS_NEEDED,
) -> DataFrame:
    """One row per document, item and offset: doc_id, text_hash, item_id, word_offset, windows, item_windows, verbatim.

    ``word_offset`` is the place in the document of the item's first word (negative if the item's start
    is cut off), ``windows`` the windows that match there, ``item_windows`` all windows of the item (1 for an
    item that is shorter than a window); ``verbatim`` speaks of the matched passage.
    """
    items = (
        benchmark.select("item_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("item_text"))
        .distinct()
        .withColumn("words", template_words(F.col("item_text")))
        .withColumn("values", valued_words(F.col("item_text")))
    )
    # Lengths of items shorter than a window; there are fewer than n of them.
    short = sorted(r[0] for r in items.select(F.size("words")).filter(F.size("words").between(1, n - 1)).distinct().collect())
    hashes = window_hashes(F.col("words"), n)
    for length in short:
        hashes = F.when(F.size("words") == length, window_hashes(F.col("words"), length)).otherwise(hashes)
    rich = F.filter(F.sequence(F.lit(0), F.size("hashes") - 1), lambda at: _literal(F.slice("words", at + 1, F.col("span"))) >= literals)
    of_items = (
        items.withColumn("hashes", hashes)
        .filter(F.size("hashes") > 0)
        .withColumn("span", F.least(F.size("words"), F.lit(n)))
        .withColumn("item_windows", F.size("hashes"))
        .withColumn("rich", rich)
        .withColumn("whole", (F.size("rich") == 0) | (F.size("words") < n))
        .select(
            "item_id",
            F.xxhash64("item_text").alias("item_hash"),
            "item_windows",
            "span",
            F.when(F.col("whole"), F.col("item_windows")).otherwise(F.least(F.lit(needed), F.size("rich"))).alias("asked"),
            (_literal(F.col("words")) < literals).alias("poor"),
            "whole",
            "rich",
            F.posexplode("hashes").alias("at", "code"),
        )
        .filter(F.col("whole") | F.array_contains("rich", F.col("at")))
        .drop("whole", "rich")
    )
    of_items = stored(of_items, "item-windows")
    bounded = of_items.count() <= BROADCAST_WINDOWS
    spread = texts(documents).select(
        "doc_id", F.xxhash64("text").alias("text_hash"), F.explode(_placed(template_words(F.col("text")), [n, *short])).alias("w")
    )
    spread = spread.select("doc_id", "text_hash", "w.place", "w.code")
    joined = spread.join(F.broadcast(of_items) if bounded else of_items, "code")
    item = ["item_id", "item_hash", "item_windows", "span", "asked", "poor"]
    found = (
        joined.select("doc_id", "text_hash", *item, (F.col("place") - F.col("at")).alias("word_offset"), "at")
        .groupBy("doc_id", "text_hash", *item, "word_offset")
        .agg(F.collect_set("at").alias("matched"))
        .withColumn("windows", F.size("matched").cast("long"))
        .filter(F.col("windows") >= F.col("asked"))
    )
    # The few documents that match are read once more for the values of their slots.
    found = stored(found, "matches")
    hit = stored(found.select("doc_id", "text_hash").distinct(), "matched-documents")
    doc_values = (
        texts(documents)
        .withColumn("text_hash", F.xxhash64("text"))
        .join(hit.withColumnRenamed("doc_id", "hit_id"), ["text_hash"], "left_semi")
        .select("doc_id", "text_hash", valued_words(F.col("text")).alias("doc_values"))
        .dropDuplicates(["doc_id", "text_hash"])
    )
    item_values = items.select(
        F.col("item_id").alias("i_id"), F.xxhash64("item_text").alias("i_hash"), F.col("values").alias("item_values")
    )
    both = found.join(item_values, F.col("item_id").eqNullSafe(F.col("i_id")) & (F.col("item_hash") == F.col("i_hash"))).join(
        doc_values.select(F.col("doc_id").alias("d_id"), F.col("text_hash").alias("d_hash"), "doc_values"),
        F.col("doc_id").eqNullSafe(F.col("d_id")) & (F.col("text_hash") == F.col("d_hash")),
    )
    return (
        both.withColumn("slots", _slot_pairs())
        .filter(F.size(F.array_distinct(F.transform("slots", lambda p: p["of_item"]))) == F.size("slots"))
        .withColumn("verbatim", ~F.exists("slots", lambda p: p["of_item"] != p["of_doc"]))
        .filter(F.col("verbatim") | ~F.col("poor"))
        .select(
            "doc_id",
            "text_hash",
            "item_id",
            "word_offset",
            "windows",
            "item_windows",
            "verbatim",
        )
    )


def _literal(words: Column) -> Column:
    """How many of the words are not placeholders."""
    return F.size(F.filter(words, lambda w: ~is_slot(w)))


def _placed(words: Column, lengths: list[int]) -> Column:
    """place and code of each run of ``lengths`` words."""

    def runs(row: Column) -> Column:
        return F.concat(*[F.transform(window_hashes(row, n), lambda c, i: F.struct(i.alias("place"), c.alias("code"))) for n in lengths])

    return with_value(words, runs)


def _slot_pairs() -> Column:
    """Different pairs of an item's slot value and the value in its place in the document, where windows matched."""
    places = F.array_distinct(F.flatten(F.transform("matched", lambda at: F.sequence(at, at + F.col("span") - 1))))
    pairs = F.transform(
        places,
        lambda i: F.struct(
            F.get(F.col("item_values"), i).alias("of_item"), F.get(F.col("doc_values"), i + F.col("word_offset")).alias("of_doc")
        ),
    )
    return F.array_distinct(
        F.filter(pairs, lambda p: is_slot(p["of_item"]) & F.coalesce(F.substring(p["of_doc"], 1, 1) == F.substring(p["of_item"], 1, 1), F.lit(False)))
    )


def drop_leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``documents`` that hold no benchmark item, with all their columns."""
    columns, key = documents.columns, "_text_hash"
    while key in columns:
        key += "_"
    leaks = stored(matches(documents, benchmark).select(F.col("text_hash").alias(key)).distinct(), "leaks")
    # The text alone decides, so its hash is enough; the leaks are few and their file size is known to the planner.
    marked_docs = documents.withColumn(key, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    return marked_docs.join(leaks, key, "left_anti").select(*columns)
