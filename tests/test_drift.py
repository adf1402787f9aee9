"""Drift detector against an independent NumPy computation, plus identities."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from windrift.operators import inject
from windrift.plans import detector as det
from windrift.plans.moments import reconstruction_mse
from windrift.plans.spline import fit_not_a_knot, make_increasing
from windrift.sources import fixtures as fx
from tests.conftest import SF_SMALL

FEATS = fx.LINEITEM_FEATURES


@pytest.fixture(scope="module")
def data(spark):
    li = fx.lineitem_features(spark, SF_SMALL)
    ref, cur = fx.split_ref_current(li)
    return li, ref, cur


@pytest.fixture(scope="module")
def model(data):
    return det.fit(data[1], FEATS)


def _np(df):
    return df.select(*FEATS).toPandas().to_numpy(dtype=float)


def _np_pca(x, frac=0.9):
    mu, sd = x.mean(0), x.std(0)
    sd[sd == 0] = 1
    z = (x - mu) / sd
    zc = z - z.mean(0)
    _, s, vt = np.linalg.svd(zc, full_matrices=False)
    ev = s ** 2 / (len(z) - 1)
    ratio = ev / ev.sum()
    k = int(np.searchsorted(np.cumsum(ratio), frac, side="right") + 1)
    return mu, sd, z.mean(0), vt[:k], ev, k


def test_scaler_and_pca_match_numpy(model, data):
    x = _np(data[1])
    mu, sd, zmean, comps, ev, k = _np_pca(x)
    assert np.allclose(model.mean, mu) and np.allclose(model.std, sd)
    assert model.pca.k == k
    assert np.allclose(model.pca.eigenvalues, ev, rtol=1e-9)
    cos = np.abs(np.sum(comps * model.pca.components, axis=1))
    assert np.allclose(cos, 1.0, atol=1e-9)


def test_reconstruction_error_matches_rows(model, data):
    x = _np(data[2])
    z = (x - model.mean) / np.where(model.std == 0, 1, model.std)
    p = model.pca.components
    rec = (z - model.pca.mean) @ p.T @ p + model.pca.mean
    direct = np.mean((z - rec) ** 2)
    scores = det.score(model, data[2]).first()
    assert scores["mse_pca"] == pytest.approx(direct, rel=1e-9)


def test_dp_zero_on_reference_and_shift_invariant(spark, model, data):
    ref = data[1]
    s0 = det.score(model, ref).first()
    assert s0["dp"] == pytest.approx(0.0, abs=1e-9)
    shifted = inject.inject_shift(ref, FEATS[:3])
    s1 = det.score(model, shifted).first()
    assert s1["dp"] == pytest.approx(0.0, abs=1e-6)      # D33: dP ignores a pure mean shift
    assert s1["de_pca"] > s0["de_pca"] + 5                # but dE sees it


def test_scores_bounded_and_noise_raises_de(spark, model, data):
    ref = data[1]
    noisy = inject.inject_noise(ref, FEATS, fx.ROW_KEY, seed=3)
    s = det.score(model, noisy).first()
    assert 0 <= s["dp"] <= 100 and 0 <= s["de_pca"] <= 100
    assert s["de_pca"] > det.score(model, ref).first()["de_pca"]


def test_degenerate_when_all_components_kept(spark):
    li = fx.lineitem_raw(spark, SF_SMALL)
    ref, _ = fx.split_ref_current(li)
    m = det.fit(ref, fx.LINEITEM_RAW_FEATURES)
    assert m.pca.k == len(fx.LINEITEM_RAW_FEATURES)
    assert det.score(m, li).first()["degenerate"] is True


def test_closed_form_close_to_permutation(spark, data):
    m_exp = det.fit(data[1], FEATS)
    m_perm = det.fit(data[1], FEATS, calibration="permute", repetitions=3, row_key=fx.ROW_KEY)
    exp = np.array(m_exp.curves[0].mse)
    perm = np.mean([c.mse for c in m_perm.curves], axis=0)
    assert np.allclose(exp, perm, rtol=0.08)
    assert len(m_perm.curves) == 3


def test_model_round_trip(spark, model, data, tmp_dir):
    model.save(spark, tmp_dir)
    back = det.DriftModel.load(spark, tmp_dir)
    a = det.score(model, data[2]).first()
    b = det.score(back, data[2]).first()
    assert a["dp"] == pytest.approx(b["dp"]) and a["de_pca"] == pytest.approx(b["de_pca"])


def test_grouped_scores_match_single(spark, model, data):
    li = data[0]
    grouped = {r["grp"]: r for r in det.score(model, li, "is_ref").collect()}
    single = det.score(model, data[2]).first()
    assert grouped["false"]["dp"] == pytest.approx(single["dp"], rel=1e-9)
    assert grouped["false"]["n_rows"] == data[2].count()


def test_constant_column_scaler():
    m = det.Moments(3.0, np.array([1.0, 0.0]), np.array([[2.0, 0.0], [0.0, 0.0]]))
    pca = det.pca_by_fraction(m, 0.9)
    assert pca.k == 1


def test_spline_reproduces_cubic_and_extrapolates():
    x = np.linspace(0.0, 2.0, 10)
    y = 1 + 2 * x - x ** 2 + 0.5 * x ** 3
    s = fit_not_a_knot(x, y)
    t = np.array([0.3, 1.7, 2.5, -0.5])
    assert np.allclose(s(t), 1 + 2 * t - t ** 2 + 0.5 * t ** 3)


def test_monotone_guard():
    x, changed = make_increasing([0.1, 0.2, 0.2, 0.15, 0.3])
    assert changed and np.all(np.diff(x) > 0)


def test_gram_identity_reconstruction():
    rng = np.random.default_rng(0)
    z = rng.normal(size=(200, 5))
    p = np.linalg.qr(rng.normal(size=(5, 2)))[0].T
    m2 = z.T @ z / len(z)
    rec = z @ p.T @ p
    assert reconstruction_mse(m2, p) == pytest.approx(np.mean((z - rec) ** 2))


def test_cell_order_is_a_bijection_both_ways():
    from windrift.plans.permute import CellOrder
    for n in (1, 2, 7, 100, 4096, 10_007):
        order = CellOrder(n, 5)
        ranks = order.rank(np.arange(n))
        assert sorted(ranks) == list(range(n)) and (order.cell(ranks) == np.arange(n)).all()


def test_scores_say_when_they_extrapolate(data):
    model = det.fit(data[1], FEATS)
    rows = det.score(model, data[1].unionByName(data[1].selectExpr(*[
        f"{c} * 9 as {c}" if c in FEATS else c for c in data[1].columns])).withColumn(
        "half", F.monotonically_increasing_id() % 2), "half").collect()
    assert len(model.curves) == 10 and all(len(c.mse) == 10 for c in model.curves)
    far = [r for r in rows if r.extrapolated]
    assert far and all(r.n_curves == 10 and r.curve_min <= r.de_pca <= r.curve_max for r in rows)
    for r in rows:  # clip each curve, then the mean
        vals = [min(max(float(c.spline()(r.mse_pca)), 0.0), 100.0) for c in model.curves]
        assert abs(r.de_pca - sum(vals) / len(vals)) < 1e-9
