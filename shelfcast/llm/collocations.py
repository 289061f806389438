"""Collocations by partitioned mining: frequent in some shard first, then counted exactly everywhere.

A phrase that occurs ``support`` times in all must occur at least ``support / SHARDS`` times in one of the
``SHARDS`` shards the documents are dealt to.  So every shard is mined completely at that lowered support, the
phrases found in any shard are the candidates, and a last pass over all documents counts every candidate.

A shard is a fixed share of the tasks, not one task: its counts are combined within each task and added up
per (shard, lang, phrase) by Spark, so shards grow with the input while tasks do not.  Within the shards words and
pairs come first, then the phrases of three and four words all of whose pairs were found.  What tasks know
of earlier passes is a bit set of hashed phrases of bounded size: a phrase that was found is always in it,
and one that is there by chance is merely counted for nothing, since sums and thresholds work on the words.

A text is held whole; counts are given out about every ``CHUNK_WORDS`` words, at the end of a text.

Edge cases: null texts are empty; a null lang is ``und`` and shares its counts with rows that say so; empty
texts and texts of separators have no words; repeated rows count as often as they occur; phrases with the same
scores are ranked by their bytes; empty tables give no rows; columns beside lang and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.sources.scratch import stored

SUPPORT = 30
LONGEST = 4
SHARDS = 6
TOP = 2_000
SCALE = 2_000_000
COVERED_PERCENT = 80
UNKNOWN = "und"
CHUNK_WORDS = 1_500_000
MOST_BITS = 1 << 28  # of the set of found phrases: 32 MB in a task
BITS_EACH = 16
PROBES = 3
_ROWS = 200_000  # of a batch given back to Spark
_CHARS = 2_000_000  # of the texts of a language that are split at a time, about
_PLACES = 1 << 16  # of a chunk that are hashed at a time

# A-Z are lowered, blanks are spaces and the marks between pieces are line feeds.
_SPLIT = bytes(
    b + 32 if 65 <= b <= 90 else 10 if chr(b) in ".,;:!?\n\x0b\x0c\r" else 32 if b in (9, 32) else b for b in range(256)
)
_EMPTY, _BREAK, _FIRST = 0, 1, 2  # numbers of what is no word, of the mark between pieces, of the first word


class _Numbers(dict):
    """Words by number, in order of appearance."""

    def __init__(self):
        super().__init__({b"": _EMPTY, b"\n": _BREAK})

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def numbered(texts: Sequence[str], numbers: _Numbers) -> np.ndarray:
    """The words of texts as numbers, with a break after each piece and each text.

    Words are told apart in columns; only the different ones become Python values.
    """
    pieces = b" \n ".join(t.encode().translate(_SPLIT).replace(b"\n", b" \n ") for t in texts) + b" \n"
    coded = pc.split_pattern(pa.array([pieces], pa.large_binary()), " ").flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    out = np.fromiter((numbers[w] for w in words), np.int32, len(words))[coded.indices.to_numpy()]
    return out[out != _EMPTY]


class _Stretch:
    """Texts of one language on their way to a chunk."""

    def __init__(self):
        self.numbers, self.parts, self.waiting, self.chars, self.words = _Numbers(), [], [], 0, 0

    def add(self, text: str) -> None:
        self.waiting.append(text)
        self.chars += len(text)
        if self.chars >= _CHARS:
            self.number()

    def number(self) -> None:
        if self.waiting:
            self.parts.append(numbered(self.waiting, self.numbers))
            self.words += len(self.parts[-1])
            self.waiting, self.chars = [], 0

    def chunk(self, lang: str) -> _Chunk:
        self.number()
        return _Chunk(lang, self.numbers, np.concatenate(self.parts))


@dataclass
class Found:
    """A set of phrases by hash: ``bits`` has all of them and, by chance, a few more."""

    bits: np.ndarray

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for probe in _probes(hashes, len(self.bits) * 64):
            left = np.flatnonzero(out)
            at = probe[left]
            out[left] = (self.bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) > 0
        return out


def _probes(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return [(hashes + np.uint64(i) * step) & np.uint64(bits - 1) for i in range(PROBES)]


def _mixed(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase from that of its beginning and of its last word."""
    x = (before ^ word) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def _word_hashes(words: Sequence[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


def _start(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(lang.encode(), 1))


class _Chunk:
    """Counts phrases of a stretch of numbered words of one language."""

    def __init__(self, lang: str, numbers: _Numbers, stream: np.ndarray):
        self.lang, self.words, self.stream = lang, list(numbers), stream
        self.size = len(self.words)
        self.inside = stream >= _FIRST

    def _runs(self, n: int) -> np.ndarray:
        """Whether n words begin at each place."""
        out = self.inside.copy()
        for k in range(1, n):
            out[:-k] &= self.inside[k:]
            out[-k:] = False
        return out

    def _hashed(self, words: np.ndarray, begin: int, lengths: Sequence[int]) -> Iterator[tuple[int, np.ndarray]]:
        """For each length, the hashes of what begins at the places of a block."""
        own = words[self.stream[begin : begin + _PLACES + max(lengths) - 1]]
        hashes = np.full(len(own), _start(self.lang), np.uint64)
        for n in range(1, max(lengths) + 1):
            last = max(len(own) - n + 1, 0)
            hashes[:last] = _mixed(hashes[:last], own[n - 1 :])
            if n in lengths:
                yield n, hashes

    def known(self, found: Found, lengths: Sequence[int]) -> dict[int, np.ndarray]:
        """For each length, whether a phrase of the set begins at each place."""
        out = {n: self._runs(n) for n in lengths}
        words = _word_hashes(self.words)
        for begin in range(0, len(self.stream), _PLACES):
            for n, hashes in self._hashed(words, begin, lengths):
                here = out[n][begin : begin + _PLACES]
                at = np.flatnonzero(here)
                here[at] = found.has(hashes[at])
        return out

    def counts(self, begins: dict[int, np.ndarray]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
        """(the words' numbers of each different phrase, its count) of the phrases that begin at the given places."""
        stream, size = self.stream, self.size
        if 1 in begins:
            found = np.bincount(stream[begins[1]], minlength=size)
            words = np.flatnonzero(found)
            yield [words], found[words]
        if 2 in begins:
            at = np.flatnonzero(begins[2])
            keys, found = np.unique(stream[at].astype(np.int64) * size + stream[at + 1], return_counts=True)
            yield [keys // size, keys % size], found
        longer = {n: np.flatnonzero(begins[n]) for n in (3, 4) if n in begins}
        if not any(len(at) for at in longer.values()):
            return
        # Longer phrases by the numbers of their pairs.
        paired = np.zeros(len(stream), bool)
        for n, at in longer.items():
            paired[at] = True
            if n == 4:
                paired[at + 2] = True
        where = np.flatnonzero(paired)
        pairs, numbers = np.unique(stream[where].astype(np.int64) * size + stream[where + 1], return_inverse=True)
        pair = np.zeros(len(stream), np.int64)
        pair[where] = numbers
        if 3 in longer:
            at = longer[3]
            keys, found = np.unique(pair[at] * size + stream[at + 2], return_counts=True)
            first = pairs[keys // size]
            yield [first // size, first % size, keys % size], found
        if 4 in longer:
            at = longer[4]
            keys, found = np.unique(pair[at] * len(pairs) + pair[at + 2], return_counts=True)
            first, second = pairs[keys // len(pairs)], pairs[keys % len(pairs)]
            yield [first // size, first % size, second // size, second % size], found

    def rows(self, shard: int, begins: dict[int, np.ndarray], total: bool) -> Iterator[pa.RecordBatch]:
        """Batches of (shard, lang, phrase, n); the empty phrase stands for the number of words."""
        words = pa.array(self.words, pa.binary()).cast(pa.string())
        if total:
            yield _batch(shard, self.lang, pa.array([""]), np.array([int(self.inside.sum())]))
        for parts, counts in self.counts(begins):
            for i in range(0, len(counts), _ROWS):
                taken = [words.take(pa.array(p[i : i + _ROWS])) for p in parts]
                phrases = pc.binary_join_element_wise(*taken, " ") if len(taken) > 1 else taken[0]
                yield _batch(shard, self.lang, phrases, counts[i : i + _ROWS])


def _batch(shard: int, lang: str, phrases: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    n = len(phrases)
    columns = [pa.array(np.full(n, shard, np.int32)), pa.array([lang] * n, pa.string()), phrases, pa.array(counts, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["shard", "lang", "phrase", "n"])


def _begins(chunk: _Chunk, step: str, found: Found | None) -> dict[int, np.ndarray]:
    """Where the phrases begin that a pass counts."""
    if step == "short":
        return {n: chunk._runs(n) for n in (1, 2)}
    if step == "every":
        return chunk.known(found, range(1, LONGEST + 1))
    pairs = chunk.known(found, (2,))[2]
    three = pairs.copy()
    three[:-1] &= pairs[1:]
    three[-1:] = False
    four = three.copy()
    four[:-1] &= three[1:]
    four[-1:] = False
    return {3: three, 4: four}


def _counted(documents: DataFrame, step: str, found: Found | None = None) -> DataFrame:
    """shard, lang, phrase, n within stretches of a task: words and pairs, longer phrases of found pairs, or all found."""
    held = documents.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = 0 if step == "every" else TaskContext.get().partitionId() % SHARDS
        langs: dict[str, _Stretch] = {}

        def done() -> Iterator[pa.RecordBatch]:
            while langs:
                lang, stretch = langs.popitem()
                chunk = stretch.chunk(lang)
                yield from chunk.rows(shard, _begins(chunk, step, held.value), step == "every")

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                langs.setdefault(lang, _Stretch()).add(text)
                if sum(x.words for x in langs.values()) >= CHUNK_WORDS:
                    yield from done()
        yield from done()

    return documents.mapInArrow(run, "shard int, lang string, phrase string, n long")


def _frequent_somewhere(counted: DataFrame, support: int, name: str) -> DataFrame:
    """The phrases that reach their share of the support in a shard."""
    sums = counted.groupBy("shard", "lang", "phrase").agg(F.sum("n").alias("n"))
    return stored(sums.filter(F.col("n") * SHARDS >= support).select("lang", "phrase").distinct(), name)


def found_set(phrases: DataFrame) -> Found:
    """The bit set of phrases: bits are set in tasks and joined by position, so its size bounds what is collected."""
    bits = 1 << 16
    while bits < min(BITS_EACH * phrases.count(), MOST_BITS):
        bits *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits // 64, np.uint64)
        for batch in batches:
            for lang, group in _by_lang(batch):
                numbers = _Numbers()
                rows = [[numbers[w] for w in p.encode().split(b" ")] for p in group]
                words = _word_hashes(list(numbers))
                lengths = np.array([len(r) for r in rows])
                for n in np.unique(lengths).tolist():
                    same = np.array([r for r in rows if len(r) == n])
                    hashes = np.full(len(same), _start(lang), np.uint64)
                    for k in range(n):
                        hashes = _mixed(hashes, words[same[:, k]])
                    for probe in _probes(hashes, bits):
                        np.bitwise_or.at(own, probe >> np.uint64(6), np.uint64(1) << (probe & np.uint64(63)))
        at = np.flatnonzero(own)
        columns = [pa.array(at.astype(np.int32)), pa.array(own[at].view(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, names=["at", "bits"])

    joined = phrases.mapInArrow(run, "at int, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    whole = np.zeros(bits // 64, np.uint64)
    whole[joined.column("at").to_numpy()] = joined.column("bits").to_numpy().astype(np.int64).view(np.uint64)
    return Found(whole)


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, list[str]]]:
    groups: dict[str, list[str]] = {}
    for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist()):
        groups.setdefault(lang, []).append(phrase)
    yield from groups.items()


def _wide(col: str | Column) -> Column:
    """A count that may be multiplied beyond 64 bits."""
    return (F.col(col) if isinstance(col, str) else col).cast("decimal(28,0)")


def frequent_phrases(documents: DataFrame, support: int = SUPPORT, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, phrase, n: exact counts of all phrases of up to four words that occur ``support`` times or more.

    The empty phrase has the number of all words of its lang.
    """
    rows = documents.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    short = _frequent_somewhere(_counted(rows, "short"), support, "short-phrases")
    pairs = short.filter(F.contains("phrase", F.lit(" ")))
    longer = _frequent_somewhere(_counted(rows, "longer", found_set(pairs)), support, "longer-phrases")
    every = _counted(rows, "every", found_set(short.unionByName(longer)))
    sums = every.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    return stored(sums.filter((F.col("n") >= support) | (F.col("phrase") == "")), "frequent-phrases")


def collocations(
    documents: DataFrame, support: int = SUPPORT, top: int = TOP, lang_col: str = "lang", text_col: str = "text"
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each lang's phrases whose parts are seen least without each other."""
    counts = frequent_phrases(documents, support, lang_col, text_col)
    words = F.split("phrase", " ")
    known = counts.filter(F.col("phrase") != "").withColumn("words", words).withColumn("size", F.size("words"))
    candidates = known.filter("size > 1").withColumnRenamed("n", "a")

    def joined(first: Column, n: Column) -> Column:
        return F.array_join(F.slice("words", first, n), " ")

    # Of every cut the counts of both parts; the parts are as frequent as the whole, so they are among the counts.
    cut = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).select(
        "lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("left"), joined(F.col("k") + 1, F.col("size") - F.col("k")).alias("right")
    )
    part = known.select("lang", "phrase", "n")
    for side, name in (("left", "l"), ("right", "r")):
        cut = cut.join(part.select("lang", F.col("phrase").alias(side), F.col("n").alias(name)), ["lang", side])
    score = F.expr(f"(cast({SCALE} as decimal(7,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    lowest = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    # The largest count of a longer candidate around each phrase.
    begins = F.explode(
        F.flatten(
            F.transform(
                F.sequence(F.lit(2), F.col("size") - 1),
                lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda i: F.array_join(F.slice("words", i, n), " ")),
            )
        )
    )
    around = candidates.filter("size > 2").select("lang", begins.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    covered = F.coalesce(100 * _wide("around") >= COVERED_PERCENT * _wide("a"), F.lit(False))
    free = lowest.join(around, ["lang", "phrase"], "left").filter(~covered)
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = free.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    totals = counts.filter(F.col("phrase") == "").select("lang", "n")
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score"
    )
