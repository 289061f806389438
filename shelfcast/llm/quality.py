"""Quality of a text, learned from trusted positives and unlabelled web text.

Non-negative positive-unlabelled learning: the risk of a classifier over all text is written with the
positives, the unlabelled rows and the share of positives among them (the class prior), and its estimated
negative part is kept from falling below zero.  The prior is the smallest ratio between the unlabelled
and the positive rows that score above a threshold.

Edge cases: a null text is empty; an empty text has a score of its own, that of a row of zero features;
ties and repeated rows score alike; an empty table gives an empty result; without positives or without
unlabelled rows every score is the prior guess of 0.5.  Columns beside id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import about, fold, known_labels, texts

FIT_ROWS = 20_000  # rows of each kind the classifier is fitted on, at most about
SYMBOLS = b"#$%&*@~^=+<>/\\_{}[]|"
FEATURES = 24


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256)
    out[list(chars)] = 1
    return out


_CLASSES = np.stack(
    [
        _table(bytes(range(65, 91))),
        _table(bytes(range(97, 123))),
        _table(bytes(range(48, 58))),
        _table(b" "),
        _table(b"\n"),
        _table(b".,;:"),
        _table(b"!?"),
        _table(b"|"),
        _table(b"#$%&*"),
        _table(SYMBOLS),
        _table(b"\"'()-"),
        _table(bytes(range(128, 256))),
        _table(bytes(range(0, 9)) + bytes(range(14, 32))),
    ],
    axis=1,
)


def features(text: str) -> np.ndarray:
    """Shares of kinds of bytes, and how much words repeat, shout or lack letters, over the whole text."""
    out = np.zeros(FEATURES)
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    if not words:
        return out
    out[:13] = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASSES / len(raw)
    n = len(words)
    out[13] = np.log1p(n)
    out[14] = sum(map(len, words)) / n / 10
    out[15] = sum(a == b for a, b in zip(words, words[1:])) / n
    out[16] = len(set(words)) / n
    out[17] = sum(map(bytes.isupper, words)) / n
    out[18] = sum(map(bytes.isalpha, words)) / n
    lines = raw.count(b"\n") + 1
    out[19] = np.log1p(n / lines)
    out[20] = (n - len(set(words))) / n * np.log1p(n)
    sentences = raw.count(b".") + raw.count(b"!") + raw.count(b"?") + 1
    out[21] = np.log1p(n / sentences)
    out[22] = len(set(raw.split(b"\n"))) / lines
    out[23] = 1.0
    return out


def feature_rows(batch: pd.Series) -> np.ndarray:
    return np.stack([features(t or "") for t in batch]) if len(batch) else np.zeros((0, FEATURES))


@dataclass
class Net:
    """One hidden layer over scaled features."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float

    def hidden(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ self.w1 + self.b1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.hidden(x) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def _new_net(x: np.ndarray, units: int, rng: np.random.Generator) -> Net:
    scale = x.std(axis=0)
    return Net(
        x.mean(axis=0), np.where(scale > 1e-9, scale, 1.0), rng.normal(0, 0.2, (x.shape[1], units)), np.zeros(units), np.zeros(units), 0.0
    )


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -40, 40)))


def fit(pos: np.ndarray, unl: np.ndarray, prior: float | None, epochs: int = 80, units: int = 16, seed: int = 7) -> Net:
    """Minimise the non-negative risk with logistic loss; ``prior`` None separates positives from unlabelled rows instead."""
    rng = np.random.default_rng(seed)
    net = _new_net(np.concatenate([pos, unl]), units, rng)
    moments: list[list] = [[0.0, 0.0] for _ in range(4)]
    step, batch = 0, 512
    for epoch in range(epochs):
        rate = 0.02 * (1 - epoch / epochs) + 0.0005
        order_u = rng.permutation(len(unl))
        for begin in range(0, len(unl), batch):
            u = unl[order_u[begin : begin + batch]]
            p = pos[rng.integers(0, len(pos), min(batch, len(pos)))]
            x = np.concatenate([p, u])
            g = net.margin(x)
            gp, gu = g[: len(p)], g[len(p) :]
            if prior is None:
                slope = np.concatenate([-_sigmoid(-gp) / len(p), _sigmoid(gu) / len(u)])
            else:
                negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
                on_unl = _sigmoid(gu) / len(u)
                on_pos = -prior * _sigmoid(gp) / len(p)
                if negative >= 0:
                    slope = np.concatenate([-prior * _sigmoid(-gp) / len(p) + on_pos, on_unl])
                else:  # the estimate of a loss fell below zero: step back on that part alone
                    slope = np.concatenate([-on_pos, -on_unl])
            h = net.hidden(x)
            back = (slope[:, None] * net.w2) * (1 - h * h)
            scaled = np.clip((x - net.mean) / net.scale, -8, 8)
            grads = [scaled.T @ back + 1e-5 * net.w1, back.sum(0), h.T @ slope + 1e-5 * net.w2, slope.sum()]
            step += 1
            for k, (name, grad) in enumerate(zip(("w1", "b1", "w2", "b2"), grads)):
                m = moments[k]
                m[0] = 0.9 * m[0] + 0.1 * grad
                m[1] = 0.999 * m[1] + 0.001 * grad * grad
                move = rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
                setattr(net, name, getattr(net, name) - move)
    return net


def class_prior(pos: np.ndarray, unl: np.ndarray, seed: int = 3) -> float:
    """Share of positives among the unlabelled rows.

    A classifier of positives against unlabelled rows is fitted on one half.  On the other half, no set
    of rows can hold a smaller share of the unlabelled than prior times its share of the positives, so
    the prior is the smallest such ratio over the sets above a threshold, each with its sampling error.
    """
    if len(pos) < 8 or len(unl) < 8:
        return 0.5
    net = fit(pos[::2], unl[::2], None, epochs=10, seed=seed)
    sp, su = np.sort(net.margin(pos[1::2])), np.sort(net.margin(unl[1::2]))
    cuts = np.quantile(sp, np.linspace(0, 0.9, 91))
    qp = 1 - np.searchsorted(sp, cuts, side="left") / len(sp)
    qu = 1 - np.searchsorted(su, cuts, side="left") / len(su)
    error = np.sqrt(np.log(40) / 2 / len(sp)) + np.sqrt(np.log(40) / 2 / len(su))
    best = np.argmin((qu + error) / qp)
    return float(np.clip(qu[best] / qp[best], 0.01, 0.99))


@dataclass
class QualityModel:
    net: Net | None
    prior: float

    def score(self, batch: pd.Series) -> np.ndarray:
        if self.net is None:
            return np.full(len(batch), 0.5)
        return self.net.score(feature_rows(batch)) if len(batch) else np.zeros(0)


def learn(documents: DataFrame, labels: DataFrame, folds: int = 5, fit_rows: int = FIT_ROWS) -> QualityModel:
    """Fit on about ``fit_rows`` trusted positives and as many unlabelled texts of the learning folds.

    The label 0 is never used: such rows are unlabelled text like any other.
    """
    trusted = about(known_labels(labels, "quality", folds).filter("label = 1").select("doc_id"), fit_rows, "doc_id", seed=1)
    web = texts(documents).filter(fold("doc_id", folds) != 0)
    collect = _collected(web.join(F.broadcast(trusted), "doc_id"))  # at most about fit_rows ids
    unlabelled = _collected(about(web, fit_rows, "doc_id", "text", seed=2))
    if not len(collect) or not len(unlabelled):
        return QualityModel(None, 0.5)
    prior = class_prior(collect, unlabelled)
    return QualityModel(fit(collect, unlabelled, prior), prior)


def _collected(df: DataFrame) -> np.ndarray:
    """Feature rows of a bounded sample, in an order that does not depend on the partitioning."""

    @F.pandas_udf("array<double>")
    def take(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(list(feature_rows(b)))

    rows = df.select(F.xxhash64("doc_id", "text").alias("k"), take("text").alias("x")).collect()
    return np.array([r["x"] for r in sorted(rows, key=lambda r: r["k"])]) if rows else np.zeros((0, FEATURES))


def quality_score(model: QualityModel, text: str | Column) -> Column:
    """Probability that the text is good, as a column."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(model.score(b))

    return score(F.coalesce((F.col(text) if isinstance(text, str) else text).cast("string"), F.lit("")))


def classify(documents: DataFrame, labels: DataFrame, folds: int = 5, threshold: float = 0.3, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of ``documents``."""
    model = learn(documents, labels, folds, fit_rows)
    scored = texts(documents).select(
        "doc_id", (fold("doc_id", folds) == 0).alias("held_out"), quality_score(model, "text").alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(documents: DataFrame, labels: DataFrame, folds: int = 5, threshold: float = 0.3, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of ``documents`` whose score reaches the threshold, with all their columns."""
    model = learn(documents, labels, folds, fit_rows)
    columns = documents.columns
    name = "_quality"
    while name in columns:
        name += "_"
    return documents.withColumn(name, quality_score(model, "text")).filter(F.col(name) >= threshold).select(*columns)
