"""Both errors in one pass, losses, histories, trends over ranges, plans."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from windrift import registry_drift, registry_jobs
from windrift.operators import inject
from windrift.plans import autoencoder as ae
from windrift.plans import detector as det
from windrift.plans import report
from windrift.plans.permute import permute_cells
from windrift.sources import fixtures as fx

FEATS = fx.LINEITEM_FEATURES


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def ref(spark):
    return fx.lineitem_features(spark, SF_SMALL).filter("is_ref")


@pytest.fixture(scope="module")
def model(ref):
    return det.fit(ref, FEATS, row_key=fx.ROW_KEY, build_ae=True, ae_params={"epochs": 8, "hidden_layers": [16, 8]})


def _versions(ref):
    """Every scenario's rows, by the single injections."""
    for i, (name, kind, share) in enumerate(inject.SCENARIOS):
        yield name, inject.inject(ref, FEATS, kind, share, fx.ROW_KEY, 42 + i).select(*FEATS).toPandas().to_numpy(dtype=float)


def test_scenarios_equal_numpy_on_each_version(model, ref):
    got = {r.grp: r for r in det.score_scenarios(model, ref, fx.ROW_KEY).collect()}
    assert len(got) == 7 and all(r.de_ae is not None for r in got.values())
    params = ae.unflatten(np.asarray(model.ae["params"]), model.ae["sizes"])
    p = model.pca.components
    for name, x in _versions(ref):
        z = (x - model.mean) / np.where(model.std == 0, 1, model.std)
        r = got[name]
        assert r.n_rows == len(x)
        assert r.mse_pca == pytest.approx(np.mean((z - ((z - model.pca.mean) @ p.T @ p + model.pca.mean)) ** 2), rel=1e-9)
        assert r.de_ae == pytest.approx(ae.ae_score(model, float(np.mean((z - ae.forward(params, z)) ** 2))), rel=1e-7, abs=1e-7)


def test_scenarios_read_rows_once(model, ref):
    plan = _plan(det.score_scenarios(model, ref, fx.ROW_KEY))
    assert len(re.findall("FileScan parquet", plan)) == 1 and "Generate" not in plan and "Expand" not in plan


def test_both_errors_come_from_one_scan(model, ref):
    assert len(re.findall("FileScan parquet", _plan(det.score(model, ref, "batch")))) == 1


@pytest.mark.parametrize("query", ["A10", "A11", "J3", "F5", "F6", "F12", "P19"])
def test_comparisons_scan_once(spark, query):
    assert len(re.findall("FileScan parquet", _plan(registry_drift.QUERIES[query](spark, SF_SMALL)))) == 1


def test_losses_fall_on_rows_held_out(model):
    h = model.ae["history"]
    assert [e for e, _, _ in h] == list(range(9))
    assert h[-1][2] < 0.6 * h[0][2] and h[-1][1] < 0.6 * h[0][1]
    assert h[-1][2] < 0.75 and abs(h[-1][2] - h[-1][1]) < 0.3  # scaled features: predicting their mean gives 1


def test_held_out_rows_do_not_train(ref, monkeypatch):
    monkeypatch.setattr(ae, "HELD_OUT", 1)  # every row is held out
    m = det.fit(ref, FEATS, row_key=None, calibration="expected", build_ae=True, ae_params={"epochs": 2, "hidden_layers": [4]})
    assert m.ae["params"] == ae.flatten(ae.init_params(m.ae["sizes"], 42)).tolist()
    assert len({h[2] for h in m.ae["history"]}) == 1


def test_history_of_several_runs(spark, model, ref, tmp_dir):
    a, b = det.score(model, ref, "batch"), det.score(model, ref)
    for _ in range(2):  # a replay adds nothing, and leaves the other run alone
        report.write_history(a, f"{tmp_dir}/h", "years")
        report.write_history(b, f"{tmp_dir}/h", "all")
    report.write_history(a.filter("n_rows > 0").limit(1), f"{tmp_dir}/h", "years")
    rows = report.read_history(spark, f"{tmp_dir}/h").collect()
    assert sorted(r.run_id for r in rows) == ["all", "years"]
    assert rows[0].asDict().keys() >= {"grp", "dp", "de_pca", "run_id"}


def test_stream_and_batches_share_a_history(spark):
    rows = registry_jobs.q_u1(spark, SF_SMALL).collect()
    assert {r.run_id for r in rows} == {"batches", "stream-0"}
    assert len(rows) == len({(r.run_id, r.grp) for r in rows})


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_trend_carries_the_last_row_of_a_range(spark, partitions):
    rows = [(s, i, float((i * 7 + (s or 0)) % 11) if i % 5 else None) for s in (1, 2, 3, None) for i in range(40 if s == 2 else 6)] + [(4, None, 1.0)]
    t = spark.createDataFrame(rows, "s int, i int, v double").repartition(4)
    got = {(r.s, r.i): (r.prev_v, r.delta_v) for r in report.trend(t, "i", "v", ["s"], partitions).collect()}
    assert len(got) == len(rows)
    for s, i, v in rows:
        before = next((x for a, b, x in rows if a == s and i is not None and b == i - 1), None)
        assert got[s, i] == (before, None if v is None or before is None else v - before)


def test_trend_has_no_window_over_everything(spark):
    o = fx.table(spark, SF_SMALL, "orders")
    plan = _plan(report.trend(o, "o_orderkey", "o_totalprice"))
    assert "SinglePartition" not in plan and "Window" in plan
    assert report.trend(o.limit(0), "o_orderkey", "o_totalprice").count() == 0


def test_permuted_cells(spark):
    t = spark.range(500).select("id", (F.col("id") * 1.0).alias("a"), F.when(F.col("id") % 7 > 0, F.col("id") + 0.5).alias("b"))
    out = permute_cells(t, ["a", "b"], ["id"], 0.31, 3)
    was, now = ({r.id: (r.a, r.b) for r in x.collect()} for x in (t, out))
    assert was.keys() == now.keys()
    cells = [sorted((repr(v) for row in x.values() for v in row)) for x in (was, now)]
    assert cells[0] == cells[1]
    moved = sum(a != b for i in was for a, b in zip(was[i], now[i], strict=True))
    assert int(1000 * 0.31) - 30 <= moved <= int(1000 * 0.31)  # a NULL may take a NULL's place
    assert "Window" not in _plan(out)


def test_curve_pieces_equal_the_splines(spark, model):
    scores = spark.createDataFrame([(str(i), 0.01 * i - 0.2) for i in range(300)], "grp string, mse_pca double")
    got = {r.grp: (r.de_pca, r.n_curves) for r in report.curve_values(spark, model, scores).collect()}
    for r in scores.collect():
        want, n = det.curve_scores(model.curves, r.mse_pca)
        assert got[r.grp] == (pytest.approx(want, abs=1e-6), n)


def test_forests_learn_their_class(spark):
    acc = registry_jobs.q_m20(spark, SF_SMALL).first()
    assert acc.accuracy > 0.9
    runs = {r.run: r for r in registry_jobs.q_m21(spark, SF_SMALL).collect()}
    assert runs["changed"].n_train == int(runs["original"].n_train * 0.7) and runs["changed"].n_test == runs["original"].n_test
    assert min(r.accuracy for r in runs.values()) > 0.85
