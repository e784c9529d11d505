"""The network's rows go through it in blocks, each by the head of its own arm: the same numbers in bounded memory."""

import tracemalloc

import numpy as np
import pytest

from liftwork.operators import network
from liftwork.operators.together import Peers


def rows(n, d=2):
    draw = np.random.default_rng(3)
    x, t = draw.normal(size=(n, d)), draw.integers(0, 2, n).astype(float)
    return x, t, (draw.random(n) < 0.3 + 0.3 * t * (x[:, 0] > 0)).astype(float)


def test_memory_of_training_does_not_grow_with_the_held_rows():
    x, t, y = rows(42_000)
    hold, u = np.arange(42_000) >= 2_000, np.random.default_rng(4).random(42_000)
    alone = Peers(0, ["here"], lambda said: [said], b"")  # of one task: no connection
    tracemalloc.start()
    try:
        w = network.train(x, t, y, u, hold, network.Net(width=32, epochs=2, batch=64), alone)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert np.isfinite(w["loss"][0]) and most < 15e6  # all layers of 40,000 rows at once have 31 MB, and as much again for what they are made from


@pytest.mark.parametrize("n", [0, 1, 700])
def test_blocks_sum_up_to_the_whole(n):
    x, t, y = rows(n)
    t[: n // 2] = 1  # most blocks have one arm
    w = network.first_weights(2, network.Net(width=6))
    assert network.total_loss(w, x, t, y) == pytest.approx(network.losses(network.forward(w, x), t, y))
    each = [network.gradients(w, x[i : i + 1], t[i : i + 1], y[i : i + 1]) for i in range(n)]
    got = network.gradients(w, x, t, y)
    assert all(np.allclose(got[k], sum((g[k] for g in each), np.zeros(w[k].shape)), atol=1e-9) for k in w)
    a = network.forward(w, x)
    miss = [np.where(t == arm, network.sigmoid(a[f"v{arm}"]) - y, 0) for arm in (0, 1)]
    for arm in (0, 1):  # over all rows, as before: those of the other arm add nothing
        inner = miss[arm][:, None] * w[f"v{arm}"][:, 0] * np.where(a[f"g{arm}"] > 0, 1, a[f"g{arm}"] + 1)
        assert np.allclose(got[f"v{arm}"], a[f"g{arm}"].T @ miss[arm][:, None], atol=1e-9) and np.allclose(got[f"g{arm}"], a["w2"].T @ inner, atol=1e-9)


def test_layers_of_the_other_arm_are_not_computed(monkeypatch):
    seen, layer = {}, network.Room.layer
    monkeypatch.setattr(network.Room, "layer", lambda room, w, name, below, *more: (seen.update({name: seen.get(name, 0) + len(below)}), layer(room, w, name, below, *more))[1])
    x, t, y = rows(900)
    network.gradients(network.first_weights(2, network.Net(width=6)), x, t, y)
    assert seen == {"w1": 900, "w2": 900, "g0": int((t == 0).sum()), "g1": int((t == 1).sum())}
