"""Log-likelihood of whole texts under a gated recurrent language model.

The corpus gives the count of every token.  The commonest tokens are the model's words; any other token is
spelled as one of ``UNKNOWN`` markers, chosen by its last two characters, and then by its share of the
counts behind that marker, so every text has a proper probability.  The network is a gated recurrent unit
with a softmax over classes of words and one over the words of a class.  It starts from the token counts and
is trained by truncated backpropagation in rounds: in each, every task trains on the documents dealt to it,
and the weights are averaged, weighed by tokens.  Each round takes its own share of the documents and all rounds
together take every one once, so training grows with the corpus.  Scoring carries the state from window to window through the whole text.

Edge cases: a null text is empty and holds the end token alone; very long texts are scored window by window;
repeated rows score alike and count each time; without training documents N and V are 0 and the scores are
those of unseen tokens; an empty table gives an empty result.  Columns beside id and text are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import fold, texts
from shelfcast.sources.scratch import stored

FOLDS = 10
VOCABULARY = 8_192  # words the network knows
LOOKUP = 200_000  # commonest tokens whose counts every task holds; the others' counts are joined
UNKNOWN = 64
HIDDEN, EMBEDDED = 32, 32
ROUNDS = SHARE = 4  # each round trains on one document in SHARE, and the rounds together on every document once
DOCS_PER_TASK = 800  # documents one training task takes in a round, about
STEPS, LANES = 16, 96  # length of a training window, streams side by side
WINDOW, ABREAST = 8_192, 512  # tokens of a scoring window, texts side by side
ROWS = 1_024  # words that take their step at once, about
SHORT = 4  # places of a word in a window that are added one by one
COUNTED = 300_000  # different tokens a task counts before it passes the counts on
PER_BLOCK = 65_536  # weights averaged in one task
ADDED = 0.1


def marker_of(word: str) -> int:
    return zlib.crc32(word[-2:].encode()) % UNKNOWN


def marker_of_bytes(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % UNKNOWN if word.isascii() else marker_of(word.decode("utf-8", "surrogatepass"))


def marker_column(word: str) -> Column:
    return F.pmod(F.crc32(F.substring(F.col(word), -2, 2).cast("binary")), F.lit(UNKNOWN)).cast("int")


def split_words(text: str) -> list[bytes]:
    """Tokens before the end: runs of anything but ASCII blanks, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def told(seen: Counter) -> pa.RecordBatch:
        words = [w.decode("utf-8", "surrogatepass") for w in seen]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "k"])

    seen: Counter = Counter()
    for batch in batches:
        for text in batch.column("text").to_pylist():
            seen.update(split_words(text))
            seen[b""] += 1
            if len(seen) > COUNTED:
                yield told(seen)
                seen = Counter()
    yield told(seen)


def token_counts(rows: DataFrame) -> DataFrame:
    """word (empty for the end), code and c, over all rows; each task adds up what it has read."""
    parts = rows.select("text").mapInArrow(_count, "word string, k long")
    return parts.groupBy("word").agg(F.sum("k").alias("c")).withColumn("code", F.xxhash64("word"))


@dataclass
class Network:
    """Weights; ``starts`` are the first words of the classes, words are numbered by falling count."""

    starts: np.ndarray
    w: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def from_counts(cls, counts: np.ndarray, seed: int = 5) -> Network:
        rng = np.random.default_rng(seed)
        n = len(counts)
        classes = max(1, int(np.sqrt(n)))
        weight = np.cumsum(np.sqrt(counts + 1))
        ends = np.searchsorted(weight, weight[-1] * np.arange(1, classes + 1) / classes)
        starts = np.unique(np.r_[0, ends[:-1] + 1])
        starts = starts[starts < n]
        of = np.searchsorted(starts, np.arange(n), side="right") - 1
        mass = np.bincount(of, counts + ADDED, len(starts))

        def small(*shape: int) -> np.ndarray:
            return rng.normal(0, 0.1, shape).astype(np.float32)

        return cls(
            starts,
            {
                "e": small(n, EMBEDDED),
                "x": small(EMBEDDED, 3 * HIDDEN) * 3,
                "u": small(HIDDEN, 3 * HIDDEN) * 2,
                "b": np.zeros(3 * HIDDEN, np.float32),
                "c": small(HIDDEN, len(starts)),
                "cb": np.log(mass / mass.sum()).astype(np.float32),
                "o": small(n, HIDDEN),
                "ob": np.log((counts + ADDED) / mass[of]).astype(np.float32),
            },
        )

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.w.values()])

    def refilled(self, flat: np.ndarray) -> Network:
        out, at = {}, 0
        for k, v in self.w.items():
            out[k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size
        return Network(self.starts, out)

    @cached_property
    def _classes(self) -> np.ndarray:
        return np.searchsorted(self.starts, np.arange(len(self.w["ob"])), side="right") - 1

    def class_of(self, ids: np.ndarray) -> np.ndarray:
        return self._classes[ids]

    def bounds(self, k: int) -> tuple[int, int]:
        return int(self.starts[k]), int(self.starts[k + 1]) if k + 1 < len(self.starts) else len(self.w["ob"])


def _order(v: np.ndarray) -> np.ndarray:
    """A stable order; small whole numbers are sorted by their digits."""
    return np.argsort(v.astype(np.uint16) if len(v) and v.max() < 1 << 16 else v, kind="stable")


def _sums_by_word(v: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums along the second axis of runs that begin at ``first``; short runs, which most are, are added place by place."""
    sizes = np.diff(np.r_[first, v.shape[1]])
    out = np.take(v, first, axis=1)
    for k in range(1, SHORT):
        run = np.flatnonzero((sizes > k) & (sizes <= SHORT))
        out[:, run] += np.take(v, first[run] + k, axis=1)
    run = np.flatnonzero(sizes > SHORT)
    if len(run):
        # The end of the last run may lie past the last place, where nothing follows.
        cuts = np.c_[first[run], first[run] + sizes[run]].ravel()
        out[:, run] = np.add.reduceat(v, cuts[:-1] if cuts[-1] == v.shape[1] else cuts, axis=1)[:, ::2]
    return out


def _halved(gates: np.ndarray) -> np.ndarray:
    """The three gates' weights one behind the other, those of both sigmoids halved: sigmoid(v) = (1 + tanh(v / 2)) / 2."""
    out = gates.reshape(-1, 3, HIDDEN).transpose(1, 0, 2).copy()
    out[:2] *= 0.5
    return out


def _advance(gx: np.ndarray, gh: np.ndarray, h: np.ndarray, out: np.ndarray) -> None:
    """One step of the unit from ``h`` to ``out``; ``gx`` gets the values of the gates."""
    zr, n = gx[:2], gx[2]
    zr += gh[:2]
    np.tanh(zr, out=zr)
    zr *= 0.5
    zr += 0.5
    n += gx[1] * gh[2]
    np.tanh(n, out=n)
    np.subtract(h, n, out=out)
    out *= gx[0]
    out += n


class _Targets:
    """Targets sorted by class.  What the words of a class get for one target is a row of ``flat``, rows lie end to end."""

    def __init__(self, net: Network, y: np.ndarray):
        of, ends = net.class_of(y), np.r_[net.starts[1:], len(net.w["ob"])]
        self.of, self.order = of, _order(of)
        sizes = (ends - net.starts)[of[self.order]]
        self.rows = np.cumsum(sizes) - sizes
        self.at = self.rows + y[self.order] - net.starts[of[self.order]]
        self.flat = np.empty(int(sizes.sum()), net.w["o"].dtype)
        many = np.bincount(of, minlength=len(net.starts))
        self.parts = []  # class, its first and last target and its part of ``flat``
        first = at = 0
        for k in np.flatnonzero(many).tolist():
            n, size = int(many[k]), int(ends[k] - net.starts[k])
            self.parts.append((k, first, first + n, self.flat[at : at + n * size].reshape(n, size)))
            first, at = first + n, at + n * size

    def exp_sums(self, fill) -> np.ndarray:
        """``fill`` writes logits to the rows; they become exponents, less the highest of a row where that is needed."""
        fill()
        with np.errstate(over="ignore"):
            np.exp(self.flat, out=self.flat)
            sums = np.add.reduceat(self.flat, self.rows)
        if not _safe(sums):
            fill()
            high = np.maximum.reduceat(self.flat, self.rows)
            self.flat -= np.repeat(high, np.diff(np.r_[self.rows, len(self.flat)]))
            np.exp(self.flat, out=self.flat)
            sums = np.add.reduceat(self.flat, self.rows)
        return sums


def _safe(sums: np.ndarray) -> bool:
    return bool(sums.min() > 1e-25 and sums.max() < 1e30)


def _exp_sums(v: np.ndarray, logits) -> tuple[np.ndarray, np.ndarray]:
    """Exponents of ``v`` in its place and the sums of rows; ``logits`` makes ``v`` anew if the highest of a row must go first."""
    ones = np.ones(v.shape[1], v.dtype)
    with np.errstate(over="ignore", invalid="ignore"):
        np.exp(v, out=v)
        sums = v @ ones
    if not _safe(sums):
        v = logits()
        v -= v.max(axis=1, keepdims=True)
        np.exp(v, out=v)
        sums = v @ ones
    return v, sums


def target_scores(net: Network, h: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Natural log probability of each target, given the state before it."""
    w = net.w

    def classes() -> np.ndarray:
        v = h @ w["c"]
        v += w["cb"]
        return v

    to = _Targets(net, y)
    e, sums = _exp_sums(classes(), classes)
    out = np.log(e[np.arange(len(y)), to.of] / sums).astype(np.float64)
    words = np.concatenate([w["o"], w["ob"][:, None]], axis=1)
    by_class = np.ones((len(y), h.shape[1] + 1), words.dtype)  # a 1 for the bias
    by_class[:, :-1] = h[to.order]

    def within() -> None:
        for k, first, last, v in to.parts:
            lo, hi = net.bounds(k)
            np.dot(by_class[first:last], words[lo:hi].T, out=v)

    sums = to.exp_sums(within)
    out[to.order] += np.log(to.flat[to.at] / sums)
    return out


def document_scores(net: Network, docs: list[np.ndarray]) -> np.ndarray:
    """Natural log probability of each document; its ids close with the end, which also stands before it."""
    out = np.zeros(len(docs))
    x, u = _halved(net.w["x"]), _halved(net.w["u"])
    table = net.w["e"] @ x + _halved(net.w["b"])
    order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
    for begin in range(0, len(order), ABREAST):
        own = order[begin : begin + ABREAST]
        sizes = np.array([len(docs[i]) for i in own])
        ids, starts = np.concatenate([docs[i] for i in own]), np.cumsum(sizes) - sizes
        state = np.zeros((len(own), HIDDEN), table.dtype)
        last = np.zeros(len(own), np.int64)
        first = 0
        while first < sizes[0]:
            live = int(np.searchsorted(-sizes, -first, side="left"))
            steps = min(max(1, WINDOW // live), int(sizes[0]) - first)
            counts = np.searchsorted(-sizes, -(first + np.arange(steps)), side="left").tolist()
            block = [ids[starts[:n] + first + t] for t, n in enumerate(counts)]
            states = np.empty((sum(counts), HIDDEN), table.dtype)
            at = 0
            for t, n in enumerate(counts):
                h, new = state[:n], states[at : at + n]
                _advance(np.take(table, last[:n], axis=1), h @ u, h, new)
                state[:n] = new
                last = block[t]
                at += n
            who = np.concatenate([np.arange(n) for n in counts])
            scores = target_scores(net, states, np.concatenate(block))
            out[own[:live]] += np.bincount(who, scores, live)
            first += steps
    return out


class Trainer:
    """Truncated backpropagation with step sizes that shrink where gradients were large.

    A word's weights and its bias are one row, so are a class's, and all words take their step together; words of
    classes that do not occur have no gradient and stay as they are.
    """

    def __init__(self, net: Network, rate: float = 0.1):
        w = {k: v.copy() for k, v in net.w.items()}
        self.words = np.concatenate([w["o"], w["ob"][:, None]], axis=1)
        self.classes = np.concatenate([w["c"], w["cb"][None]])
        w |= {"o": self.words[:, :-1], "ob": self.words[:, -1], "c": self.classes[:-1], "cb": self.classes[-1]}
        self.net = Network(net.starts, w)
        self.weights = {"words": self.words, "classes": self.classes} | {k: w[k] for k in ("e", "x", "u", "b")}
        self.seen = {k: np.full(v.shape, 1e-6, v.dtype) for k, v in self.weights.items()}
        self.rate = rate
        self.of_class = [self.words[slice(*net.bounds(k))] for k in range(len(net.starts))]
        # Classes that take their step at once, and the words of them; few enough to stay near the processor.
        cuts = sorted({int(np.searchsorted(net.starts, lo)) for lo in range(0, len(self.words), ROWS)} | {len(net.starts)})
        self.groups = [(a, b, net.bounds(a)[0], net.bounds(b - 1)[1]) for a, b in zip(cuts[:-1], cuts[1:])]
        most = max(hi - lo for *_, lo, hi in self.groups)
        self.grad, self.spare = np.empty((2, most, self.words.shape[1]), self.words.dtype)
        self.grad_of_class = [self.grad[slice(*(v - lo for v in net.bounds(k)))] for a, b, lo, _ in self.groups for k in range(a, b)]

    def _step(self, name: str, grad: np.ndarray) -> None:
        seen = self.seen[name]
        seen += grad * grad
        self.weights[name] -= self.rate * grad / np.sqrt(seen)

    def _step_words(self, lo: int, hi: int) -> None:
        """The same for some words, without copies."""
        grad, seen, own = self.grad[: hi - lo], self.seen["words"][lo:hi], self.spare[: hi - lo]
        np.multiply(grad, grad, out=own)
        seen += own
        np.sqrt(seen, out=own)
        np.divide(grad, own, out=own)
        own *= self.rate
        self.words[lo:hi] -= own

    def window(self, x: np.ndarray, y: np.ndarray, fresh: np.ndarray, h0: np.ndarray, real: np.ndarray | None = None) -> np.ndarray:
        """One update from a window (steps, lanes); ``fresh`` marks document starts, ``real`` (if not all) what is
        a token and not padding; returns the last state."""
        w, kind = self.net.w, self.words.dtype
        steps, lanes = x.shape
        total = steps * lanes
        flat_x, flat_y = x.ravel(), y.ravel()
        # Each different word passes through the weights once.
        by_word = _order(flat_x)
        new = np.r_[True, np.diff(flat_x[by_word]) != 0]
        first = np.flatnonzero(new)
        rows = flat_x[by_word[first]]
        place = np.empty(total, np.int64)
        place[by_word] = np.cumsum(new) - 1
        emb = w["e"][rows]
        gx = np.take(emb @ _halved(w["x"]) + _halved(w["b"]), place, axis=1).reshape(3, steps, lanes, HIDDEN)
        u, keep, starts = _halved(w["u"]), (1 - fresh).astype(kind)[:, :, None], fresh.any(axis=1).tolist()
        gh = np.empty((steps, 3, lanes, HIDDEN), kind)
        past = np.empty((steps, lanes, HIDDEN), kind)
        by_one = np.ones((total, HIDDEN + 1), kind)  # states and a 1 for the bias
        states = np.empty((steps, lanes, HIDDEN), kind)
        h = h0
        for t in range(steps):
            if starts[t]:
                np.multiply(h, keep[t], out=past[t])
            else:
                past[t] = h
            np.matmul(past[t], u, out=gh[t])
            _advance(gx[:, t], gh[t], past[t], states[t])
            h = states[t]
        by_one[:, :-1] = states.reshape(total, HIDDEN)
        share = np.ones(total, kind) if real is None else real.ravel().astype(kind)
        share /= share.sum()

        # Gradients are taken of exponents less their sum at the target, and scaled row by row.
        to = _Targets(self.net, flat_y)
        p, sums = _exp_sums(by_one @ self.classes, lambda: by_one @ self.classes)
        p[np.arange(total), to.of] -= sums
        scale = (share / sums)[:, None]
        dh = p @ w["c"].T
        dh *= scale
        classes = (by_one * scale).T @ p

        by_class = by_one[to.order]

        def within() -> None:
            for k, begin, end, v in to.parts:
                np.dot(by_class[begin:end], self.of_class[k].T, out=v)

        sums = to.exp_sums(within)
        to.flat[to.at] -= sums
        scale = (share[to.order] / sums)[:, None]
        by_class *= scale
        back = np.empty_like(by_class)
        parts = {part[0]: part for part in to.parts}
        for a, b, lo, hi in self.groups:
            found = False
            for k in range(a, b):
                if k in parts:
                    _, begin, end, v = parts[k]
                    np.dot(v, self.of_class[k], out=back[begin:end])
                    np.dot(v.T, by_class[begin:end], out=self.grad_of_class[k])
                    found = True
                else:
                    self.grad_of_class[k].fill(0)
            if found:
                self._step_words(lo, hi)
        back *= scale
        dh[to.order] += back[:, :-1]

        dh = dh.reshape(steps, lanes, HIDDEN)
        z, r, n = gx
        slope = 1 - n * n
        slope *= 1 - z
        by_gate = np.empty_like(gx)  # what a change of the state changes before each gate, and in the last one's share of the past
        np.multiply(past - n, z * (1 - z), out=by_gate[0])
        np.multiply(slope, r, out=by_gate[2])
        np.multiply(by_gate[2], gh[:, 2] * (1 - r), out=by_gate[1])
        ut = np.ascontiguousarray(w["u"].reshape(HIDDEN, 3, HIDDEN).transpose(1, 2, 0))
        back, d = np.zeros_like(past[0]), np.empty_like(past)
        for t in range(steps - 1, -1, -1):
            np.add(dh[t], back, out=d[t])
            by_gate[:, t] *= d[t]
            back = np.add.reduce(by_gate[:, t] @ ut, axis=0)
            back += d[t] * z[t]
            if starts[t]:
                back *= keep[t]
        du = past.reshape(total, HIDDEN).T @ by_gate.reshape(3, total, HIDDEN)
        np.multiply(d, slope, out=by_gate[2])
        dgx = _sums_by_word(np.take(by_gate.reshape(3, total, HIDDEN), by_word, axis=1), first)
        flat = dgx.transpose(1, 0, 2).reshape(len(rows), 3 * HIDDEN)
        grads = {"classes": classes, "u": du.transpose(1, 0, 2).reshape(HIDDEN, 3 * HIDDEN), "b": flat.sum(0), "x": emb.T @ flat}
        de = flat @ w["x"].T
        seen = self.seen["e"][rows] + de * de
        self.seen["e"][rows] = seen
        w["e"][rows] -= self.rate * de / np.sqrt(seen)
        for k, g in grads.items():
            self._step(k, np.clip(g, -1, 1))
        return h

    def documents(self, docs: list[np.ndarray]) -> int:
        """Train on documents laid end to end in parallel lanes; the number of tokens."""
        y = np.concatenate(docs)
        fresh = np.zeros(len(y), np.int8)
        fresh[np.r_[0, np.cumsum([len(d) for d in docs])[:-1]]] = 1
        x = np.where(fresh == 1, 0, np.r_[0, y[:-1]])
        lanes = max(1, min(LANES, len(y) // (40 * STEPS)))
        size = -(-len(y) // lanes)
        real = np.ones(len(y), bool)
        # The last lane is filled up with padding, which is fewer than ``lanes`` tokens; the last window may be shorter.
        xs, ys, fs, rs = (np.pad(v, (0, lanes * size - len(y))).reshape(lanes, size).T for v in (x, y, fresh, real))
        h = np.zeros((lanes, HIDDEN), self.words.dtype)
        for begin in range(0, size, STEPS):
            at = slice(begin, begin + STEPS)
            h = self.window(xs[at], ys[at], fs[at], h, rs[at])
        return len(y)


@dataclass
class Words:
    """The commonest tokens: their counts, and the id that stands for each in the network."""

    place: dict[bytes, int]
    counts: np.ndarray
    ids: np.ndarray
    marker_ids: np.ndarray
    behind: np.ndarray  # counts behind each marker, with what was added
    spelled: np.ndarray  # whether a token stands behind a marker
    markers: np.ndarray

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray, Counter]:
        """Network ids, places of the tokens that are held here (-1 for others), and the others."""
        words = split_words(text)
        words.append(b"")
        at = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        ids = self.ids[at] if len(self.ids) else np.zeros(len(at), np.int64)
        if at[-1] < 0:
            ids[-1] = 0
        places = np.flatnonzero(at[:-1] < 0).tolist()
        others = [words[k] for k in places]
        ids[places] = self.marker_ids[[marker_of_bytes(w) for w in others]] if others else 0
        return ids, at, Counter(others)


def _code(word: bytes) -> int:
    h = xxhash.xxh64_intdigest(word, 42)  # the hash that xxhash64 gives in SQL
    return h - (1 << 64) if h >= 1 << 63 else h


@dataclass
class Model:
    net: Network
    words: Words
    total: int
    kinds: int


def vocabulary(counts: DataFrame, size: int, lookup: int) -> tuple[Words, np.ndarray]:
    """What every task holds: at most ``lookup`` tokens, ``size`` of them known to the network.

    The different counts are at most the square root of twice the tokens.
    """
    # How many tokens have each count tells which counts are among the highest; only those come to the driver.
    tally = sorted(((r["c"], r["n"]) for r in counts.groupBy("c").agg(F.count("*").alias("n")).collect()), reverse=True)
    least, taken = 0, 0
    for c, n in tally:
        if taken + n > lookup:
            break
        least, taken = c, taken + n
    top = counts.filter(F.col("c") >= least).select("word", "c").collect() if taken else []
    top.sort(key=lambda r: (-r["c"], r["word"]))
    place = {r["word"].encode("utf-8", "surrogatepass"): i for i, r in enumerate(top)}
    c = np.array([r["c"] for r in top], np.float64)
    known = np.zeros(len(top), bool)
    known[:size] = True
    if b"" in place:
        known[place[b""]] = True
    markers = np.array([marker_of(r["word"]) for r in top], np.int64)
    in_net = [r["word"] for r, k in zip(top, known) if k]
    behind = np.full(UNKNOWN, ADDED)
    all_by_marker = counts.groupBy(marker_column("word").alias("m")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()
    for r in all_by_marker:
        behind[r["m"]] += r["c"] + ADDED * r["n"]
    for w, n in zip(in_net, c[known]):
        behind[marker_of(w)] -= n + ADDED
    behind = np.maximum(behind, ADDED)
    # Ids by falling count, the end first: it also stands before a text.
    entries = [("w", i, c[i]) for i in np.flatnonzero(known) if top[i]["word"] != ""] + [("m", m, behind[m]) for m in range(UNKNOWN)]
    entries.sort(key=lambda e: -e[2])
    ids, marker_ids = np.zeros(len(top), np.int64), np.zeros(UNKNOWN, np.int64)
    net_counts = [float(c[place[b""]]) if b"" in place else 0.0]
    for k, (kind, i, n) in enumerate(entries, 1):
        net_counts.append(float(n))
        if kind == "w":
            ids[i] = k
        else:
            marker_ids[i] = k
    ids = np.where(known, ids, marker_ids[markers]) if len(top) else ids
    return Words(place, c, ids, marker_ids, behind, ~known, markers), np.array(net_counts)


def train(coded: DataFrame, net: Network, documents: int, rounds: int = ROUNDS, share: int = SHARE) -> Network:
    """Rounds of training in parallel, each on one document in ``share`` of those not held out, and averaging."""
    spark, kind = coded.sparkSession, id_kind(net)
    tasks = max(1, round(documents / share / DOCS_PER_TASK))
    lots = max(1, tasks // 32)
    for turn in range(rounds):
        sent = spark.sparkContext.broadcast(net)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            trainer, tokens, lot = Trainer(sent.value), 0, TaskContext.get().partitionId() % lots
            for batch in batches:
                for begin in range(0, batch.num_rows, 400):
                    tokens += trainer.documents(_ids(batch.slice(begin, 400).column("ids"), kind))
            if tokens:
                flat = trainer.net.flat()
                blocks = range(0, len(flat), PER_BLOCK)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([b // PER_BLOCK for b in blocks], pa.int32()),
                        pa.array([lot] * len(blocks), pa.int32()),
                        pa.array([float(tokens)] * len(blocks), pa.float64()),
                        pa.array([(flat[b : b + PER_BLOCK].astype(np.float64) * tokens).tobytes() for b in blocks], pa.binary()),
                    ],
                    names=["block", "lot", "weight", "sums"],
                )

        chosen = coded.filter(~F.col("held_out") & (F.col("turn") == turn))
        trained = chosen.select("ids").repartition(tasks).mapInArrow(run, _SUMS)
        added = trained.groupBy("block", "lot").applyInPandas(_add_up, _SUMS).groupBy("block").applyInPandas(_add_up, _SUMS)
        got = added.collect()  # one copy of the weights
        if not got:
            continue  # a small table may have no document in this share
        got.sort(key=lambda r: r["block"])
        net = net.refilled(np.concatenate([np.frombuffer(r["sums"], np.float64) / r["weight"] for r in got]))
    return net


_SUMS = "block int, lot int, weight double, sums binary"


def _add_up(rows: pd.DataFrame) -> pd.DataFrame:
    total = np.sum([np.frombuffer(b, np.float64) for b in rows["sums"]], axis=0)
    return pd.DataFrame({"block": [rows["block"].iloc[0]], "lot": [0], "weight": [rows["weight"].sum()], "sums": [total.tobytes()]})


def id_kind(net: Network) -> np.dtype:
    """How a document's ids are written; two bytes each, if they fit."""
    return np.dtype("<u2" if len(net.w["ob"]) <= 1 << 16 else "<u4")


def _ids(column: pa.Array, kind: np.dtype) -> list[np.ndarray]:
    return [np.frombuffer(b, kind).astype(np.int64) for b in column.to_pylist()]


def coded(rows: DataFrame, words, kind: np.dtype, total: int, kinds: int) -> DataFrame:
    """Each text split once, for training and scoring: its ids, its counts and base score as far as its tokens are
    held in every task, what the markers' shares add (own), and the codes of its other tokens with their times."""
    unit = float(np.log10(total + ADDED * (kinds + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = words.value
        log_counts = np.log10(w.counts + ADDED)
        log_behind = np.log10(w.behind)
        within = np.where(w.spelled, log_counts - log_behind[w.markers], 0.0) if len(w.counts) else np.zeros(0)
        for batch in batches:
            for begin in range(0, batch.num_rows, 2500):
                part = batch.slice(begin, 2500)
                out: dict[str, list] = {k: [] for k in ("ids", "n_tokens", "known", "base", "own", "codes", "times")}
                for text in part.column("text").to_pylist():
                    ids, at, rare = w.tokens(text)
                    here = at[at >= 0]
                    base = log_counts[here].sum() - len(at) * unit
                    if at[-1] < 0:
                        base += np.log10(ADDED)
                    out["ids"].append(ids.astype(kind).tobytes())
                    out["n_tokens"].append(len(at))
                    out["known"].append(len(here))
                    out["base"].append(base)
                    out["own"].append(within[here].sum() - sum(log_behind[marker_of_bytes(x)] * k for x, k in rare.items()))
                    out["codes"].append([_code(x) for x in rare])
                    out["times"].append(list(rare.values()))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("held_out"),
                        part.column("turn"),
                        pa.array(out["ids"], pa.binary()),
                        pa.array(out["n_tokens"], pa.int64()),
                        pa.array(out["known"], pa.int64()),
                        pa.array(out["base"], pa.float64()),
                        pa.array(out["own"], pa.float64()),
                        pa.array(out["codes"], pa.list_(pa.int64())),
                        pa.array(out["times"], pa.list_(pa.int32())),
                    ],
                    names=["doc_id", "held_out", "turn", *out],
                )

    doc_id = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(
        run,
        f"doc_id {doc_id}, held_out boolean, turn long, ids binary, n_tokens long, known long, base double, own double, "
        "codes array<long>, times array<int>",
    )


def score(
    documents: DataFrame,
    folds: int = FOLDS,
    vocabulary_size: int = VOCABULARY,
    lookup: int = LOOKUP,
    rounds: int = ROUNDS,
    share: int = SHARE,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of each row."""
    spark = documents.sparkSession
    rows = texts(documents)
    learned = rows.filter(fold("doc_id", folds) != 0)
    counts = stored(token_counts(learned), "counts")
    sums = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.max(F.when(F.col("word") == "", F.col("c"))).alias("d")).first()
    total, kinds = int(sums["n"] or 0), int(sums["v"])
    held, net_counts = vocabulary(counts, vocabulary_size, lookup)
    words, net = spark.sparkContext.broadcast(held), Network.from_counts(net_counts)
    kind = id_kind(net)
    turn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(share)).cast("long")
    found = coded(rows.select("doc_id", "text", (fold("doc_id", folds) == 0).alias("held_out"), turn.alias("turn")), words, kind, total, kinds)
    # Numbered in the written table, so a number stays with its row.
    found = stored(found.withColumn("row", F.monotonically_increasing_id()), "coded")
    if total:
        net = train(found, net, int(sums["d"] or 0), rounds, share)
    sent = spark.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 5000):
                part = batch.slice(begin, 5000)
                network = document_scores(sent.value, _ids(part.column("ids"), kind)) / np.log(10)
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(network, pa.float64())], names=["row", "network"])

    first = stored(found.select("row", "ids").mapInArrow(run, "row long, network double"), "network-scores")
    others = found.select("row", F.explode(F.arrays_zip("codes", "times")).alias("o")).select("row", F.col("o.codes").alias("code"), F.col("o.times").alias("k"))
    added = (
        others.join(counts.select("code", "c"), "code", "left")
        .groupBy("row")
        .agg(
            F.sum(F.col("k") * F.log10(F.coalesce("c", F.lit(0)) + ADDED)).alias("logs"),
            F.sum(F.when(F.col("c").isNotNull(), F.col("k")).otherwise(0)).alias("seen"),
        )
    )
    logs = F.coalesce("logs", F.lit(0.0))
    return (
        found.select("row", "doc_id", "held_out", "n_tokens", "known", "base", "own")
        .join(first, "row")
        .join(added, "row", "left")
        .select(
            "doc_id",
            "held_out",
            "n_tokens",
            (F.col("known") + F.coalesce("seen", F.lit(0))).cast("long").alias("n_known"),
            F.lit(total).cast("long").alias("train_tokens"),
            (F.col("base") + logs).alias("base_score"),
            (F.col("own") + F.col("network") + logs).alias("score"),
        )
    )
