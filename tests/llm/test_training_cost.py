"""The cost of a training token: few calls an update, each text split once; updates follow the plain gradient."""

from __future__ import annotations

import sys

import numpy as np
import pytest

from shelfcast.llm import lm


def _net(n: int, kind=np.float64) -> lm.Network:
    net = lm.Network.from_counts(np.sort(np.random.default_rng(1).zipf(1.3, n).clip(max=9_999))[::-1].astype(float))
    net.w = {k: v.astype(kind) for k, v in net.w.items()}
    return net


def _loss(net: lm.Network, x, y, fresh, h0, real) -> float:
    """Mean natural log loss of the real targets, token by token."""
    w, hid, out = net.w, lm.HIDDEN, 0.0
    for lane in range(x.shape[1]):
        h = h0[lane]
        for t in range(len(x)):
            h = h * (1 - fresh[t, lane])
            gx, gh = w["e"][x[t, lane]] @ w["x"] + w["b"], h @ w["u"]
            z, r = (1 / (1 + np.exp(-gx[i : i + hid] - gh[i : i + hid])) for i in (0, hid))
            new = np.tanh(gx[2 * hid :] + r * gh[2 * hid :])
            h = new + z * (h - new)
            k = int(net.class_of(y[t, lane]))
            lo, hi = net.bounds(k)
            of_class, of_word = h @ w["c"] + w["cb"], w["o"][lo:hi] @ h + w["ob"][lo:hi]
            got = of_class[k] - np.log(np.exp(of_class).sum()) + of_word[y[t, lane] - lo] - np.log(np.exp(of_word).sum())
            out -= got * real[t, lane]
    return out / real.sum()


def test_an_update_follows_the_plain_gradient():
    rng = np.random.default_rng(2)
    net = _net(30)
    x, y = rng.integers(0, 30, (2, 7, 4))
    x[:, :2] = x[0, 0]  # a word at many places and others at few
    fresh, real = (rng.random(x.shape) < 0.2).astype(np.int8), np.ones(x.shape, bool)
    real[5:, 3] = False
    h0 = rng.normal(0, 0.3, (4, lm.HIDDEN))
    trainer = lm.Trainer(net)
    before = {k: v.copy() for k, v in net.w.items()}
    trainer.window(x, y, fresh, h0, real)
    assert all((before[k] == net.w[k]).all() for k in before)
    for k, v in net.w.items():
        for at in rng.integers(0, v.size, 12):
            place = np.unravel_index(at, v.shape)
            held, losses = v[place], []
            for d in (1e-5, -1e-5):
                v[place] = held + d
                losses.append(_loss(net, x, y, fresh, h0, real))
            v[place] = held
            g = (losses[0] - losses[1]) / 2e-5
            g = g if k in ("e", "o", "ob") else np.clip(g, -1, 1)
            want = held - trainer.rate * g / np.sqrt(g * g + 1e-6)
            assert trainer.net.w[k][place] == pytest.approx(want, abs=2e-5), (k, place)


def test_scores_far_from_each_other():
    net = _net(60)
    doc = np.random.default_rng(3).integers(0, 60, 50)
    whole = lm.document_scores(net, [doc])[0]
    for far in (200.0, -200.0):
        net.w["cb"], net.w["ob"] = net.w["cb"] + far * 5, net.w["ob"] - far * 5
        assert lm.document_scores(net, [doc])[0] == pytest.approx(whole, rel=1e-6)


def test_an_update_takes_few_calls():
    net = _net(lm.VOCABULARY, np.float32)
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, lm.VOCABULARY, (2, lm.STEPS, lm.LANES))
    trainer, calls = lm.Trainer(net), []
    sys.setprofile(lambda frame, event, arg: calls.append(event) if event in ("call", "c_call") else None)
    try:
        trainer.window(x, y, np.zeros(x.shape, np.int8), np.zeros((lm.LANES, lm.HIDDEN), np.float32))
    finally:
        sys.setprofile(None)
    assert len(calls) < 1_500


def test_a_text_is_split_once(spark):
    texts = ["A b c a", "", "b ünï rare-word", "a", None]
    rows = spark.createDataFrame([(i, t or "", i == 1, i % 2) for i, t in enumerate(texts)], "doc_id int, text string, held_out boolean, turn long")
    counts = lm.token_counts(rows.select("text")).cache()
    words, net_counts = lm.vocabulary(counts, 2, 4)
    net = lm.Network.from_counts(net_counts)
    total = int(net_counts.sum())
    out = lm.coded(rows, spark.sparkContext.broadcast(words), lm.id_kind(net), total, counts.count()).cache()
    for r in out.collect():
        ids, at, others = words.tokens(texts[r["doc_id"]] or "")
        assert np.frombuffer(r["ids"], lm.id_kind(net)).tolist() == ids.tolist()
        assert (r["n_tokens"], r["known"]) == (len(ids), int((at >= 0).sum()))
        assert sorted(zip(r["codes"], r["times"])) == sorted((lm._code(w), k) for w, k in others.items())
    # Training reads the ids of the rows that are not held out; no text is left in them.
    assert "text" not in out.columns
    moved = lm.train(out, net, 4, 2, 2).flat() - net.flat()
    assert np.abs(moved).max() > 0
    assert (lm.train(out.filter("held_out"), net, 1, 2, 2).flat() == net.flat()).all()
