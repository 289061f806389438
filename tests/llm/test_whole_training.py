"""Training takes every token of every document."""

from __future__ import annotations

import numpy as np

from shelfcast.llm import lm


def test_training_takes_every_token_and_document(monkeypatch):
    assert lm.ROUNDS == lm.SHARE
    docs = [np.full(n, 1) for n in (700, 13, 4000, 1, 90)]
    trainer = lm.Trainer(lm.Network.from_counts(np.arange(20, 0, -1).astype(float)))
    seen, inner = [], trainer.window

    def window(x, y, fresh, h0, real):
        seen.append((int(real.sum()), int(fresh[real].sum())))
        return inner(x, y, fresh, h0, real)

    monkeypatch.setattr(trainer, "window", window)
    assert trainer.documents(docs) == 4804
    assert np.sum(seen, axis=0).tolist() == [4804, 5]


def test_padding_does_not_change_an_update():
    rng = np.random.default_rng(3)
    net = lm.Network.from_counts(np.arange(20, 0, -1).astype(float))
    x, y = rng.integers(1, 20, (2, 6, 3))
    fresh, h0 = np.zeros((6, 3), np.int8), np.zeros((3, lm.HIDDEN), np.float32)
    real = np.ones((6, 3), bool)
    real[4:, 2] = False
    one, two = lm.Trainer(net), lm.Trainer(net)
    one.window(x, y, fresh, h0, real)
    x[4:, 2], y[4:, 2] = 0, 0
    two.window(x, y, fresh, h0, real)
    assert all(np.allclose(one.net.w[k], two.net.w[k], atol=1e-6) for k in net.w)
