"""What of a layer's state goes to the blocks."""

import numpy as np
import pytest
from florapark.operators import fitting, layer


def test_only_weights_go_to_the_blocks():
    rng = np.random.default_rng(5)
    labels = [np.array([i % 3]) for i in range(200)]
    block = fitting.Block(np.arange(200), rng.normal(size=(200, 4)), np.zeros(200), np.ones(200), np.zeros(200), labels)
    method = layer.LayerMethod(layer.Layer(), 3)
    s, done = method.begin({"part": 0}), False
    for rounds in range(1, 16):
        block.memo = {}
        sent = method.needed(s)
        total = method.step(sent, block)
        block.memo = {}
        assert np.array_equal(total, method.step(s, block))
        s, done = method.solve(s, total, rounds)
        if done:
            break
    assert rounds > 5 and not done
    assert 5 * len(fitting._keep(method.needed(s))) < len(fitting._keep(s))


@pytest.mark.parametrize("codes", ["", "l", "p", "lqp", "t", "h", "qth", "lqpth"])
def test_products_by_levels_are_those_with_the_columns(codes):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(300, 4)), 2)
    x[0], x[1], x[2] = layer.SPAN[0], layer.SPAN[1], np.linspace(*layer.SPAN, layer.LEVELS)[7]
    z = np.hstack([np.ones((300, 1)), layer.expand(x, codes)])
    w, r, levels = rng.normal(size=(z.shape[1], 3)), rng.normal(size=(300, 3)), layer.Levels(x, codes)
    assert np.allclose(levels.times(w), z @ w, atol=1e-9) and np.allclose(levels.sums(r), z.T @ r, atol=1e-9)


def test_alike_columns_do_not_cost_rounds():
    """The 2,000 vectors of sf0.1 took 193 rounds before moves were turned."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 16)) * 0.15
    labels = [np.array([k]) for k in rng.integers(0, 4, 2000)]
    block = fitting.Block(np.arange(2000), x, np.zeros(2000), np.ones(2000), np.zeros(2000), labels)
    method, done, rounds = layer.LayerMethod(layer.Layer(), 4), False, 0
    s = method.begin({"part": 0})
    while not done:
        rounds += 1
        s, done = method.solve(s, method.step(s, block), rounds)
    z, w = np.hstack([np.ones((2000, 1)), layer.expand(x, "lqpth")]), method.weights(s)
    mu = 1 / (1 + np.exp(-z @ w))
    for k in range(4):
        y = np.array([v[0] == k for v in labels])
        g = z.T @ (mu[:, k] - y) + np.r_[0.0, w[1:, k]]
        assert abs(g[0]) <= 0.02 and np.abs(g[1:] - g[0] * z[:, 1:].mean(0)).max() <= 1.1e-3 * np.sqrt(y.sum())
    assert rounds < 40
