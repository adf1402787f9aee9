"""The autoencoder's training step and forward pass against their plain formulas."""

import tracemalloc

import numpy as np

from windrift.plans import autoencoder as ae


def _plain_forward(params, x):
    acts = [x]
    for i in range(0, len(params), 2):
        h = acts[-1] @ params[i] + params[i + 1]
        acts.append(np.maximum(h, 0.0) if i + 2 < len(params) else h)
    return acts


def _plain_epoch(params, x_noisy, x_clean, batch_size, lr, rng):
    params = [p.copy() for p in params]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    order = rng.permutation(len(x_clean))
    x_noisy, x_clean = x_noisy[order], x_clean[order]
    for t, start in enumerate(range(0, len(order), batch_size), 1):
        y = x_clean[start:start + batch_size]
        acts = _plain_forward(params, x_noisy[start:start + batch_size])
        delta, grads = 2.0 * (acts[-1] - y) / y.size, [None] * len(params)
        for i in range(len(params) - 2, -1, -2):
            grads[i], grads[i + 1] = acts[i // 2].T @ delta, delta.sum(axis=0)
            delta = (delta @ params[i].T) * (acts[i // 2] > 0)
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g ** 2
            params[i] -= lr * (m[i] / (1 - 0.9 ** t)) / (np.sqrt(v[i] / (1 - 0.999 ** t)) + 1e-7)
    return params


def _rows(n, d, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    return x, x + 0.1 * rng.normal(size=x.shape)


def test_training_step_is_plain_adam():
    for hidden, n in (([64, 32], 330), ([5], 64), ([8, 4, 2], 3)):  # with a shorter last batch, without, with that alone
        params = ae.init_params(ae.layer_sizes(7, hidden), 42)
        kept = [p.copy() for p in params]
        x, noisy = _rows(n, 7)
        got = ae.train_epoch(params, noisy, x, 32, 0.001, np.random.default_rng(1))
        want = _plain_epoch(params, noisy, x, 32, 0.001, np.random.default_rng(1))
        assert all(g.shape == w.shape and np.allclose(g, w, rtol=1e-9, atol=1e-12) for g, w in zip(got, want, strict=True))
        assert all(np.array_equal(p, k) for p, k in zip(params, kept, strict=True))


def test_forward_keeps_activations_of_a_block_only():
    params = ae.init_params(ae.layer_sizes(7, [64, 32]), 42)
    x, _ = _rows(40_000, 7)
    tracemalloc.start()
    out = ae.forward(params, x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(out, _plain_forward(params, x)[-1], rtol=1e-9, atol=1e-12)
    assert ae.forward(params, x[:0]).shape == (0, 7)
    assert peak < out.nbytes + 8 * 2048 * 64 * 4  # all rows at once: 20 MB and more for one layer
