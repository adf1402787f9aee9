"""Permutation calibration and autoencoder training at scale: same results with less work and fewer bytes."""

import os
import pickle

import numpy as np
import pytest

from windrift.plans import autoencoder as ae
from windrift.plans import permute
from windrift.session import scratch_path


def _brute(x, reconstruct, repetitions, seed, levels):
    """The calibration of the matrix ``x`` by permuting it whole."""
    out = {}
    for rep in range(repetitions):
        order = permute.CellOrder(x.size, seed * 1000 + rep)
        at = order.cell(np.arange(x.size))
        for p in levels:
            m, w = int(x.size * p), x.ravel().copy()
            w[at[:m]] = np.roll(w[at[:m]], -1)
            out[rep, round(p * 100, 6)] = float(np.mean((x - reconstruct(w.reshape(x.shape))) ** 2))
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 5000])
def test_calibration_is_the_whole_permutation(spark, monkeypatch, n):
    monkeypatch.setattr(permute, "PART_CELLS", 700)
    monkeypatch.setattr(permute, "LEAST_CELLS", 100)
    monkeypatch.setattr(permute, "SEND_CELLS", 2000)
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(n, 3)), 1)
    q = np.full((3, 3), 1 / 3)
    levels = permute.LEVELS
    table = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double").repartition(3)
    rows, total = permute._numbered(table, ["a", "b", "c"])
    seen = spark.sparkContext.accumulator(0)

    def reconstruct(w):
        seen.add(len(w))
        return w @ q

    monkeypatch.setattr(permute, "_numbered", lambda *a, **k: (rows, total))
    got = permute.calibration_table_generic(table, ["a", "b", "c"], [], reconstruct, 4, 5).collect()
    made = np.array([r[1:] for r in sorted((r["row"], r["x0"], r["x1"], r["x2"]) for r in rows.collect())])
    want = _brute(made, lambda w: w @ q, 4, 5, levels)
    assert {(r.rep, round(r.perm_pct, 6)) for r in got} == set(want)
    for r in got:
        assert r.mse == pytest.approx(want[r.rep, round(r.perm_pct, 6)], rel=1e-9, abs=1e-12)
    if n > 1000:  # a row is reconstructed only where a level changes it; values travel without their places
        assert seen.value < 0.7 * n * 4 * len(levels)
        assert "ids" not in permute._PUSH


def test_step_makes_no_arrays_as_long_as_the_weights(monkeypatch):
    """One step is the textbook Adam step; its weights are one array, so that it is a few operations."""
    rng = np.random.default_rng(1)
    params = ae.init_params(ae.layer_sizes(3, [5, 2]), 4)
    x = rng.normal(size=(7, 3))
    made = ae.train_epoch(params, x, x, 7, 0.01, np.random.default_rng(2))
    assert all(p.base is made[0].base is not None for p in made)
    flat, eps = ae.flatten(params), 1e-5
    loss = lambda w: float(np.mean((ae.forward(ae.unflatten(w, ae.layer_sizes(3, [5, 2])), x) - x) ** 2))
    slope = np.array([(loss(flat + e) - loss(flat - e)) / (2 * eps) for e in np.eye(len(flat)) * eps])
    moved = np.abs(slope) > 1e-4  # the first step of Adam goes by the learning rate, against the slope
    assert np.allclose((ae.flatten(made) - flat)[moved], -0.01 * np.sign(slope[moved]), atol=1e-4)


def test_order_works_by_tables_as_long_as_the_root(monkeypatch):
    """The rounds' functions are worked out for every half once, not for every cell, and tables do not travel with the order."""
    n, worked = 40_000, []
    mix = permute.CellOrder._mix
    monkeypatch.setattr(permute.CellOrder, "_mix", lambda self, x, i, mod: worked.append(len(x)) or mix(self, x, i, mod))
    order = permute.CellOrder(n, 5)
    cells = np.arange(n)
    ranks = order.rank(cells)
    assert np.array_equal(np.sort(ranks), cells) and np.array_equal(order.cell(ranks), cells)
    assert sum(worked) <= 4 * 201
    assert len(pickle.dumps(order)) < 2000
    left, right = cells // order.b, cells % order.b  # the plain rounds
    for i in (0, 2):
        left = (left + mix(order, right, i, order.a).astype(np.int64)) % order.a
        right = (right + mix(order, left, i + 1, order.b).astype(np.int64)) % order.b
    plain = left * order.b + right
    assert np.array_equal(ranks[plain < n], plain[plain < n]) and (plain < n).mean() > 0.9


def test_training_rows_are_read_as_blocks(spark):
    """A pass over the training rows takes whole blocks over, with the same losses as training on the rows at hand."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(700, 3))
    x[5, 1] = np.nan  # an incomplete row is left out
    frame = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, a double, b double, c double").coalesce(1)
    base = scratch_path(spark, "autoencoder").removeprefix("file:")
    before = set(os.listdir(base)) if os.path.isdir(base) else set()
    made = ae.fit_autoencoder(frame, ["a", "b", "c"], None, {"hidden_layers": [4, 2], "epochs": 2, "noise_factor": 0.0})
    (path,) = set(os.listdir(base)) - before
    written = spark.read.parquet(os.path.join(base, path))
    assert written.columns == ["block"] and written.count() == 1
    block = np.frombuffer(written.first()["block"], np.float64).reshape(7, -1)
    assert np.array_equal(block[:3].T, np.delete(x, 5, axis=0)) and np.array_equal(block[:3], block[3:6])
    rows, held = block[:3].T, block[6] > 0
    sizes = ae.layer_sizes(3, [4, 2])
    params, history = ae.init_params(sizes, 42), []
    for epoch in range(3):
        err = np.mean((rows - ae.forward(params, rows)) ** 2, axis=1)
        history.append((epoch, err[~held].mean(), err[held].mean()))
        if epoch < 2:
            params = ae.train_epoch(params, rows[~held], rows[~held], 32, 0.001, np.random.default_rng([42_000 + epoch, 0, 0]))
    assert np.allclose(np.array(made["history"]), np.array(history), rtol=1e-9)
