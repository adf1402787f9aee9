"""Grouped moments across many tasks, scenario matrix and autoencoder."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from windrift.operators import inject
from windrift.plans import detector as det
from windrift.plans.moments import group_moments, tree_sum
from windrift.sources import fixtures as fx
from tests.conftest import SF_SMALL

FEATS = fx.LINEITEM_FEATURES


def test_moments_merge_across_partitions_and_groups(spark):
    li = fx.lineitem_features(spark, SF_SMALL).repartition(13)   # many tasks, groups spread over all
    mom = group_moments(li, FEATS, "batch")
    pdf = li.select("batch", *FEATS).toPandas()
    assert set(mom) == {str(b) for b in pdf.batch.unique()}
    for b, part in pdf.groupby("batch"):
        x = part[FEATS].to_numpy(dtype=float)
        m = mom[str(b)]
        assert m.n == len(x)
        assert np.allclose(m.mean, x.mean(0), rtol=1e-12)
        c = x - x.mean(0)
        assert np.allclose(m.scatter, c.T @ c, rtol=1e-9)


def test_moments_stable_for_large_means(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 3)) + 1e9          # raw products would lose all digits
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double").repartition(7)
    m = group_moments(df, ["a", "b", "c"])["__all__"]
    assert np.allclose(m.cov, np.cov(x.T), rtol=1e-6)


def test_tree_sum(spark):
    rows = [("k", i % 5, [float(i), 1.0]) for i in range(100)]
    df = spark.createDataFrame(rows, "grp string, salt int, g array<double>").repartition(9)
    out = tree_sum(df, 3).collect()
    assert len(out) == 1 and out[0]["g"] == [float(sum(range(100))), 100.0]


def test_scenario_matrix_one_scan(spark):
    li = fx.lineitem_features(spark, SF_SMALL)
    ref, _ = fx.split_ref_current(li)
    m = det.fit(ref, FEATS)
    res = {r["grp"]: r for r in det.score_scenarios(m, ref, fx.ROW_KEY).collect()}
    n = ref.count()
    assert res["No Drift"]["dp"] == pytest.approx(0.0, abs=1e-9)
    assert res["20% Data Deletion"]["n_rows"] == int(n * 0.8)
    assert res["Mean Shift"]["dp"] == pytest.approx(0.0, abs=1e-6)
    assert res["Mean Shift"]["de_pca"] > 10 * max(res["No Drift"]["de_pca"], 0.1)
    assert res["Added Noise"]["dp"] > 5 and res["Added Noise"]["de_pca"] > 5
    # the union form (one frame per scenario) gives the same moments
    for name, kind, inten in inject.SCENARIOS:
        if kind in ("shift", "missing"):
            single = inject.inject(ref, FEATS, kind, inten, fx.ROW_KEY,
                                   seed=42 + [s[0] for s in inject.SCENARIOS].index(name))
            s = det.score(m, single).first()
            assert s["dp"] == pytest.approx(res[name]["dp"], abs=1e-9)
            assert s["n_rows"] == res[name]["n_rows"]


def test_autoencoder_small(spark):
    li = fx.lineitem_features(spark, SF_SMALL)
    ref, _ = fx.split_ref_current(li)
    m = det.fit(ref, FEATS, row_key=fx.ROW_KEY, build_ae=True,
                ae_params={"hidden_layers": [8, 4], "epochs": 2})
    assert m.ae["sizes"] == [7, 8, 4, 8, 7]
    assert len(m.ae["curves"]) >= 1
    s = det.score(m, li, "is_ref").collect()
    assert all(r["de_ae"] is None or 0 <= r["de_ae"] <= 100 for r in s)
    import tempfile
    path = tempfile.mkdtemp(prefix="ae-model-")
    m.save(spark, path)
    back = det.DriftModel.load(spark, path)
    a = {r["grp"]: r["de_ae"] for r in s}
    b = {r["grp"]: r["de_ae"] for r in det.score(back, li, "is_ref").collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a if a[k] is not None)


def test_scores_for_many_small_groups(spark):
    """Scoring runs on the executors per group; hundreds of groups (some of a
    single row) all get a row with bounded scores."""
    li = fx.lineitem_features(spark, SF_SMALL)
    ref, _ = fx.split_ref_current(li)
    m = det.fit(ref, FEATS)
    keyed = fx.table(spark, SF_SMALL, "lineitem").select("l_partkey").distinct().count()
    g = fx.lineitem_features(spark, SF_SMALL).join(
        fx.table(spark, SF_SMALL, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").dropDuplicates(
            ["l_orderkey", "l_linenumber"]), ["l_orderkey", "l_linenumber"])
    res = det.score(m, g, "l_partkey")
    rows = res.collect()
    assert len(rows) == g.select("l_partkey").distinct().count() <= keyed
    assert all(0.0 <= r["dp"] <= 100.0 for r in rows)
    assert all(r["de_pca"] is None or 0.0 <= r["de_pca"] <= 100.0 for r in rows)


def test_null_group_and_dropped_rows_are_counted(spark, monkeypatch):
    from windrift.plans import moments
    monkeypatch.setattr(moments, "FLUSH_GROUPS", 3)
    rows = [(None if i % 5 == 0 else f"g{i % 11}", float(i), None if i % 7 == 0 else float(i * i % 13)) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(3)
    got = moments.group_moments(df, ["x", "y"], "g")
    want = {}
    for g, x, y in rows:
        want.setdefault(g, []).append((x, y))
    assert set(got) == set(want) and None in got
    for g, pairs in want.items():
        whole = np.array([p for p in pairs if p[1] is not None])
        assert got[g].n == len(whole) and got[g].dropped == len(pairs) - len(whole)
        np.testing.assert_allclose(got[g].mean, whole.mean(0))
        np.testing.assert_allclose(got[g].scatter, (whole - whole.mean(0)).T @ (whole - whole.mean(0)), atol=1e-6)
