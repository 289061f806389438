"""Toxicity by a learned lexicon, matched with edits and weighed by context.

The lexicon holds words and word stems that labelled toxic texts use far more than the others.  It is
kept as a trie; a Levenshtein automaton runs over the trie, so one walk over a word finds every entry
within the allowed edits.  Each hit is then looked at in a window of its text: a term that is quoted or
reported counts as quotation, any other as abuse.  A logistic model of the counts gives the score.

Edge cases: a null text is empty and scores as a text without hits; ties and repeated rows score alike;
an empty table gives an empty result; without labels the lexicon is empty and every score is the base
rate guess.  Very long texts are read whole; a word longer than any entry ends its walk early.  Columns
beside id and text are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import about, fold, known_labels, texts

FIT_ROWS = 12_000  # labelled rows the lexicon and the weights are fitted on, at most about
MAX_TERMS = 5_000  # entries of the lexicon, strongest first
STEMS = (4, 5)
MEMO = 400_000  # words a worker remembers as clean before it starts anew
WINDOW = 60  # characters looked at on either side of a hit

WORD = re.compile(r"\w+")
REPORTED = re.compile(r"\b(said|says|say|wrote|writes|called|quote|quoted|word|words|term|terms|phrase|insult|slur)\b")
DIRECTED = re.compile(r"\b(you|your|you're|youre|u|ur)\b")
OPENING, CLOSING = "\"“«‘„", "\"”»’“"


class Lexicon:
    """A trie of entries and the edits each allows, walked by an automaton that is built as words need it.

    A state is a set of (trie node, edits so far).  Reading a letter moves along an edge for free; a
    letter that does not fit is a substitution or an insertion, and an edge taken without a letter is a
    deletion.  States and moves met before are looked up, so a common walk costs one lookup a letter.
    """

    LIMIT = 100_000

    def __init__(self, words: list[str], stems: list[str], exact: frozenset[str] = frozenset()):
        self.edges: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]  # edits allowed where an entry ends
        self.stem: list[bool] = [False]
        self.room: list[int] = [0]  # most edits any entry below allows
        for w in words:
            edits = 0 if w in exact else self.edits(w)
            node = self._add(w, edits)
            self.ends[node] = max(self.ends[node], edits)
        for s in stems:
            self.stem[self._add(s, 0)] = True
        self._reset()

    @staticmethod
    def edits(word: str) -> int:
        return 0 if len(word) < 5 else 1 if len(word) < 9 else 2

    def _add(self, entry: str, edits: int) -> int:
        node = 0
        self.room[0] = max(self.room[0], edits)
        for ch in entry:
            if ch not in self.edges[node]:
                self.edges[node][ch] = len(self.edges)
                self.edges.append({})
                self.ends.append(-1)
                self.stem.append(False)
                self.room.append(0)
            node = self.edges[node][ch]
            self.room[node] = max(self.room[node], edits)
        return node

    def _reset(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.sets: list[dict[int, int]] = []
        self.moves: list[dict[str, int]] = []
        self.best: list[int] = []
        self.dead = self._state({})
        self.start = self._state(self._closed({0: 0}))

    def _closed(self, at: dict[int, int]) -> dict[int, int]:
        todo = list(at.items())
        while todo:
            node, e = todo.pop()
            for child in self.edges[node].values():
                if e + 1 <= self.room[child] and at.get(child, 9) > e + 1:
                    at[child] = e + 1
                    todo.append((child, e + 1))
        return at

    def _state(self, at: dict[int, int]) -> int:
        key = frozenset(at.items())
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(at)
            self.moves.append({})
            self.best.append(min((e for n, e in at.items() if e <= self.ends[n]), default=-1))
        return self.ids[key]

    def _move(self, state: int, ch: str) -> int:
        to: dict[int, int] = {}

        def put(node: int, e: int) -> None:
            if e <= self.room[node] and to.get(node, 9) > e:
                to[node] = e

        for node, e in self.sets[state].items():
            if ch in self.edges[node]:
                child = self.edges[node][ch]
                to[child] = min(to.get(child, 9), e)
            put(node, e + 1)
            for child in self.edges[node].values():
                put(child, e + 1)
        nxt = self._state(self._closed(to))
        self.moves[state][ch] = nxt
        return nxt

    def distance(self, word: str) -> int:
        """Fewest edits to an entry (0 for a stem's word), or -1."""
        node = 0
        for ch in word:
            node = self.edges[node].get(ch, -1)
            if node < 0:
                break
            if self.stem[node]:
                return 0
        if len(self.sets) > self.LIMIT:
            self._reset()
        state = self.start
        for ch in word:
            nxt = self.moves[state].get(ch)
            state = self._move(state, ch) if nxt is None else nxt
            if state == self.dead:
                return -1
        return self.best[state]


@dataclass
class ToxicModel:
    words: list[str] = field(default_factory=list)
    stems: list[str] = field(default_factory=list)
    exact: frozenset[str] = frozenset()  # words whose near spellings are common in clean text
    weights: np.ndarray = field(default_factory=lambda: np.array([-3.0, 2.0, 0.7, 0.4, 0.2]))

    def digest(self) -> int:
        return zlib.crc32("\n".join([*self.words, "", *self.stems, "", *sorted(self.exact)]).encode())


_HELD: dict[int, tuple[Lexicon, dict[str, int], set[str]]] = {}


def _matcher(model: ToxicModel) -> tuple[Lexicon, dict[str, int], set[str]]:
    """The automaton of a model and the words it has judged; one per worker process."""
    key = model.digest()
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = (Lexicon(model.words, model.stems, model.exact), {}, set())
    return _HELD[key]


def is_quotation(lower: str, start: int, end: int) -> bool:
    """Whether the window around a hit shows it as quoted or reported rather than said to someone."""
    before, after = lower[max(0, start - WINDOW) : start], lower[end : end + WINDOW]
    before, after = re.split(r"[.!?\n]", before)[-1], re.split(r"[.!?\n]", after)[0]
    marks = [before.rfind(c) for c in OPENING]
    opened = max(marks) >= 0 and before.count('"') % 2 == (1 if '"' in before else 0)
    score = -2 * (opened and any(c in after for c in CLOSING))
    score -= bool(REPORTED.search(before))
    score += bool(DIRECTED.search(before) or DIRECTED.search(after))
    return score < 0


def hits(model: ToxicModel, text: str) -> tuple[int, int, int, int]:
    """Abusive hits with 0, 1 and 2 edits, and quoted hits, over the whole text."""
    lexicon, known, clean = _matcher(model)
    lower = text.lower()
    bad = {}
    for w in set(WORD.findall(lower)) - clean:
        d = known.get(w)
        if d is None:
            d = lexicon.distance(w)
            if d < 0:
                if len(clean) > MEMO:
                    clean.clear()
                clean.add(w)
                continue
            if len(known) > MEMO:
                known.clear()
            known[w] = d
        bad[w] = d
    out = [0, 0, 0, 0]
    if bad:
        for m in WORD.finditer(lower):
            d = bad.get(m.group())
            if d is not None:
                out[3 if is_quotation(lower, m.start(), m.end()) else d] += 1
    return tuple(min(x, 3) for x in out)


NEAR = 6  # smallest word hashes that near copies have in common


def spread_terms(label_text: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each different word and stem of a text with the text's label and a hash that near copies share."""
    for batch in label_text:
        terms, labels, groups = [], [], []
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = {w for w in WORD.findall(text.lower()) if 3 <= len(w) <= 24 and not w.isdigit()}
            if not words:
                continue
            lowest = sorted({zlib.crc32(w.encode()) for w in words})[:NEAR]
            group = zlib.crc32(b"".join(h.to_bytes(4, "little") for h in lowest))
            own = words | {f"{w[:k]}*" for w in words for k in STEMS if len(w) > k}
            terms += own
            labels += [label] * len(own)
            groups += [group] * len(own)
        yield pa.RecordBatch.from_arrays(
            [pa.array(terms, pa.string()), pa.array(labels, pa.int32()), pa.array(groups, pa.int64())],
            names=["term", "label", "grp"],
        )


def learn_lexicon(rows: DataFrame, precision: float = 0.8, alpha: float = 0.01, max_terms: int = MAX_TERMS) -> tuple[list[str], list[str]]:
    """Words and stems whose texts are toxic more often than chance explains.

    Near copies count once, so a copied text does not turn its rare words into terms.
    """
    spread = rows.select("label", "text").mapInArrow(spread_terms, "term string, label int, grp long").distinct()
    counts = spread.groupBy("term").agg(F.sum("label").alias("t"), F.count("*").alias("n"))
    base = rows.agg(F.avg("label").alias("b")).first()["b"]
    if not base or base >= 1:
        return [], []
    often = counts.filter((F.col("t") >= 3))
    candidates = max(often.count(), 1)
    q = F.least(F.col("t") / F.col("n"), F.lit(1 - 1e-9))
    evidence = F.col("n") * (q * F.log(q / base) + (1 - q) * F.log((1 - q) / (1 - base)))
    strong = (
        often.withColumn("e", evidence)
        .filter((F.col("t") >= precision * F.col("n")) & (F.col("e") >= float(np.log(candidates / alpha))))
        .orderBy(F.desc("e"), "term")
        .limit(max_terms)
        .collect()
    )
    found = [r["term"] for r in strong]
    stems = sorted(t[:-1] for t in found if t.endswith("*"))
    # A stem that only repeats one entry says no more than the word itself.
    words = sorted(t for t in found if not t.endswith("*"))
    broad = [s for s in stems if sum(w.startswith(s) for w in words) != 1]
    return words, broad


def _innocent(rows: DataFrame, model: ToxicModel, least: int) -> frozenset[str]:
    """Entries that ``least`` or more clean texts hold a different spelling of; those match exactly only."""

    @F.pandas_udf("array<string>")
    def near(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lexicon = Lexicon(model.words, model.stems)
        for b in batches:
            yield pd.Series([[w for w in set(WORD.findall(t.lower())) if lexicon.distance(w) > 0] for t in b], dtype=object)

    found = rows.filter("label = 0").select(F.explode(near("text")).alias("w")).groupBy("w").count().collect()
    seen: Counter = Counter()
    for w in model.words:
        single = Lexicon([w], [])
        for r in found:
            if abs(len(r["w"]) - len(w)) <= 2 and single.distance(r["w"]) > 0:
                seen[w] += r["count"]
    return frozenset(w for w, n in seen.items() if n >= least)


def _fit_weights(tuples: Counter, prior: np.ndarray) -> np.ndarray:
    """Logistic weights by Newton steps, drawn towards ``prior`` where the labels say little."""
    x = np.array([[1, *k[:4]] for k in tuples], float)
    y = np.array([k[4] for k in tuples], float)
    n = np.array(list(tuples.values()), float)
    w, pull = prior.copy(), np.array([0.01, 0.5, 0.5, 0.5, 0.5])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (p - y)) + pull * (w - prior)
        hess = (x * (n * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(pull)
        move = np.linalg.solve(hess, grad)
        w = w - np.clip(move, -1, 1)
    w[1:] = np.maximum(w[1:], 0)
    return w


def learn(documents: DataFrame, labels: DataFrame, folds: int = 5, fit_rows: int = FIT_ROWS) -> ToxicModel:
    """Lexicon and weights from about ``fit_rows`` labelled rows of the learning folds."""
    chosen = about(known_labels(labels, "toxic", folds), fit_rows, "doc_id", seed=1)
    rows = texts(documents).join(F.broadcast(chosen), "doc_id")  # at most about fit_rows ids
    model = ToxicModel()
    model.words, model.stems = learn_lexicon(rows)
    model.exact = _innocent(rows, model, least=2)
    counted = rows.select(_hits(model, "text").alias("h"), "label").groupBy("h", "label").count().collect()
    tuples = Counter({(*map(int, r["h"].split()), r["label"]): r["count"] for r in counted})
    if tuples:
        model.weights = _fit_weights(tuples, model.weights)
    return model


def _hits(model: ToxicModel, text: str) -> Column:
    @F.pandas_udf("string")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([" ".join(map(str, hits(model, t))) for t in b], dtype=object)

    return found(text)


def toxicity_score(model: ToxicModel, text: str | Column) -> Column:
    """Probability that the text is toxic, as a column."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            x = np.array([[1, *hits(model, t)] for t in b], float).reshape(len(b), 5)
            yield pd.Series(1 / (1 + np.exp(-np.clip(x @ model.weights, -30, 30))))

    return score(F.coalesce((F.col(text) if isinstance(text, str) else text).cast("string"), F.lit("")))


def classify(documents: DataFrame, labels: DataFrame, folds: int = 5, threshold: float = 0.5, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of ``documents``."""
    model = learn(documents, labels, folds, fit_rows)
    scored = texts(documents).select(
        "doc_id", (fold("doc_id", folds) == 0).alias("held_out"), toxicity_score(model, "text").alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_clean(documents: DataFrame, labels: DataFrame, folds: int = 5, threshold: float = 0.5, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of ``documents`` that score below the threshold, with all their columns."""
    model = learn(documents, labels, folds, fit_rows)
    columns = documents.columns
    name = "_toxicity"
    while name in columns:
        name += "_"
    return documents.withColumn(name, toxicity_score(model, "text")).filter(F.col(name) < threshold).select(*columns)
