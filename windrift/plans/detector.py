"""Drift detector on Spark.

Data never leaves the executors: a fit is one G1 pass over the reference
(count, mean and centred scatter, from which the scaler and the scaled
covariance follow on the driver); a score is one G1 pass over the current
data, grouped by batch or scenario key, after which the executors turn each
group's packed moments into its scores (eigen decomposition, curve
evaluation), so any number of groups can be scored.  The driver only ever
sees one group's d×d matrix (the reference) and the ten 10-point curves.

Scores follow the loading-based (dP) and reconstruction-based (dE) metrics:

* dP = 100·(1 − Σ λₐ·|cos(pₐ_ref, pₐ_cur)| / Σ λₐ), components paired by rank
  up to the smaller count, weights = reference eigenvalues (D32);
* dE = mean over calibration curves of clip(curve(mse), 0, 100) where mse is
  the error of the current data against its own reconstruction by the
  reference components (D25, D28).
"""

from __future__ import annotations

import json
import os
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windrift.functions.columns import qcol
from windrift.functions.scalar import standardize
from windrift.plans.moments import (
    GROUP_ALL,
    Moments,
    collect_moments,
    group_moments,
    moments_table,
    reconstruction_mse,
    unpack_moments,
)
from windrift.plans.spline import fit_not_a_knot, make_increasing

# Calibration levels 1 %, 11 %, …, 91 % (ten levels, D24) and
# ten repetitions.
LEVELS = [0.01 + 0.1 * i for i in range(10)]
REPETITIONS = 10


# --------------------------------------------------------------------------- A12 / F4
def scaler_stats(df: DataFrame, cols: Sequence[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean and population std per feature (one aggregate pass)."""
    aggs = [F.count(F.lit(1)).alias("_n")]
    for j, c in enumerate(cols):
        aggs += [F.avg(qcol(c)).alias(f"m{j}"), F.stddev_pop(qcol(c)).alias(f"s{j}")]
    row = df.agg(*aggs).first()
    mean = np.array([row[f"m{j}"] if row[f"m{j}"] is not None else 0.0 for j in range(len(cols))])
    std = np.array([row[f"s{j}"] if row[f"s{j}"] is not None else 0.0 for j in range(len(cols))])
    return mean, std, int(row["_n"])


def scale_columns(df: DataFrame, cols: Sequence[str], mean: np.ndarray, std: np.ndarray,
                  keep: Sequence[str] = ()) -> DataFrame:
    """F4 applied to every feature, as column expressions (scale 1 where the
    population std is 0, D22)."""
    exprs = [standardize(qcol(c).cast("double"), float(mean[j]), float(std[j])).alias(c)
             for j, c in enumerate(cols)]
    return df.select(*[qcol(k) for k in keep], *exprs)


# --------------------------------------------------------------------------- M6
@dataclass
class Pca:
    components: np.ndarray  # k × d, unit rows, canonical sign
    eigenvalues: np.ndarray  # all d, descending (sample covariance)
    ratios: np.ndarray       # all d
    k: int
    mean: np.ndarray         # d, PCA centre

    @property
    def top_eigenvalues(self) -> np.ndarray:
        return self.eigenvalues[: self.k]

    @property
    def min_gap(self) -> float:
        ev = self.eigenvalues[: self.k + 1]
        return float(np.min(np.abs(np.diff(ev)))) if len(ev) > 1 else float("nan")


def pca_by_fraction(m: Moments, fraction: float | int = 0.90) -> Pca:
    """M6: eigen decomposition of the sample covariance; ``k`` is the smallest
    count whose cumulative ratio is strictly above ``fraction`` (D23), or the
    integer given.  Signs: largest-magnitude loading positive (D18)."""
    cov = m.cov
    vals, vecs = np.linalg.eigh(cov)
    order = np.argsort(vals)[::-1]
    vals = np.clip(vals[order], 0.0, None)
    vecs = vecs[:, order].T
    for a in range(vecs.shape[0]):
        idx = int(np.argmax(np.abs(vecs[a])))
        if vecs[a, idx] < 0:
            vecs[a] = -vecs[a]
    total = vals.sum()
    ratios = vals / total if total > 0 else np.zeros_like(vals)
    d = len(vals)
    if isinstance(fraction, int) and not isinstance(fraction, bool) and fraction >= 1:
        k = min(int(fraction), d)
    else:
        k = int(min(d, 1 + np.count_nonzero(np.cumsum(ratios) <= fraction + 0.0)))
    return Pca(vecs[:k], vals, ratios, k, m.mean.copy())


# --------------------------------------------------------------------------- M8 (expected form)
def expected_calibration_mse(m2: np.ndarray, s2: float, comps: np.ndarray, p: float) -> float:
    """Closed-form expectation of the calibration error at permutation share
    ``p``: a chosen cell takes the value of a random other cell (mean 0,
    mean square ``s2`` after scaling); error between the original and the
    reconstruction of the permuted data:

    ``[tr M − 2(1−p)·tr QM + (1−p)²·tr QM + Σᵢ Qᵢᵢ(p(1−p)Mᵢᵢ + p·s²)] / d``
    with ``Q = PᵀP``.
    """
    d = m2.shape[0]
    q = comps.T @ comps
    tq = float(np.trace(q @ m2))
    diag = float(np.sum(np.diag(q) * (p * (1 - p) * np.diag(m2) + p * s2)))
    return (float(np.trace(m2)) - 2 * (1 - p) * tq + (1 - p) ** 2 * tq + diag) / d


@dataclass
class Curve:
    mse: list[float]
    pct: list[float]
    guarded: bool = False

    def spline(self):
        x, guarded = make_increasing(self.mse)
        self.guarded = self.guarded or guarded
        return fit_not_a_knot(x, self.pct)


def curve_scores(curves: Sequence[Curve], mse: float) -> tuple[float | None, int]:
    """A15 + F3: evaluate each curve at ``mse``, clip each to [0, 100], then
    average (D28).  Returns (score or None, usable curve count) (D29)."""
    vals = []
    for c in curves:
        try:
            v = float(c.spline()(mse))
        except (ValueError, np.linalg.LinAlgError):
            continue
        if np.isfinite(v):
            vals.append(min(max(v, 0.0), 100.0))
    return (float(np.mean(vals)) if vals else None), len(vals)


# --------------------------------------------------------------------------- model
@dataclass
class DriftModel:
    features: list[str]
    mean: np.ndarray
    std: np.ndarray
    n_ref: int
    pca: Pca
    m2_ref: np.ndarray             # second moment of the scaled reference about the PCA centre
    s2_ref: float                  # mean square of all scaled cells
    curves: list[Curve] = field(default_factory=list)
    calibration: str = "permute"
    fraction: float | int = 0.90
    ae: dict | None = None         # autoencoder weights and curves, when built

    @property
    def d(self) -> int:
        return len(self.features)

    @property
    def degenerate(self) -> bool:
        """All components kept → reconstruction error ≈ 0 whatever the drift."""
        return self.pca.k >= self.d

    # ---------------------------------------------------------------- S15
    def save(self, spark: SparkSession, path: str) -> None:
        """Persist as four small Parquet tables plus a JSON header."""
        d = self.d
        scaler = [(j, f, float(self.mean[j]), float(self.std[j])) for j, f in enumerate(self.features)]
        spark.createDataFrame(scaler, "j int, feature string, mean double, std double") \
            .coalesce(1).write.mode("overwrite").parquet(os.path.join(path, "scaler"))
        load = [(a, j, float(self.pca.components[a, j])) for a in range(self.pca.k) for j in range(d)]
        spark.createDataFrame(load, "component int, j int, value double") \
            .coalesce(1).write.mode("overwrite").parquet(os.path.join(path, "loadings"))
        eig = [(a, float(self.pca.eigenvalues[a]), float(self.pca.ratios[a])) for a in range(d)]
        spark.createDataFrame(eig, "component int, lambda double, ratio double") \
            .coalesce(1).write.mode("overwrite").parquet(os.path.join(path, "eigen"))
        cal = [(r, float(p), float(m)) for r, c in enumerate(self.curves) for p, m in zip(c.pct, c.mse)]
        spark.createDataFrame(cal, "rep int, perm_pct double, mse double") \
            .coalesce(1).write.mode("overwrite").parquet(os.path.join(path, "calibration"))
        header = {"features": self.features, "n_ref": self.n_ref, "k": self.pca.k,
                  "pca_mean": self.pca.mean.tolist(), "m2_ref": self.m2_ref.tolist(), "s2_ref": self.s2_ref,
                  "calibration": self.calibration, "fraction": self.fraction}
        if self.ae is not None:   # weights and curves: a few thousand numbers
            header["ae"] = {"sizes": list(self.ae["sizes"]), "params": list(self.ae["params"]),
                            "curves": [[list(c.mse), list(c.pct)] for c in self.ae.get("curves", [])]}
        spark.createDataFrame([(json.dumps(header),)], "header string").coalesce(1) \
            .write.mode("overwrite").parquet(os.path.join(path, "header"))

    @staticmethod
    def load(spark: SparkSession, path: str) -> DriftModel:
        header = json.loads(spark.read.parquet(os.path.join(path, "header")).first()["header"])
        sc = sorted(spark.read.parquet(os.path.join(path, "scaler")).collect(), key=lambda r: r["j"])
        d = len(sc)
        eig = sorted(spark.read.parquet(os.path.join(path, "eigen")).collect(), key=lambda r: r["component"])
        comps = np.zeros((header["k"], d))
        for r in spark.read.parquet(os.path.join(path, "loadings")).collect():
            comps[r["component"], r["j"]] = r["value"]
        curves: dict[int, list] = {}
        for r in spark.read.parquet(os.path.join(path, "calibration")).collect():
            curves.setdefault(r["rep"], []).append((r["perm_pct"], r["mse"]))
        cl = [Curve([m for _, m in sorted(v)], [p for p, _ in sorted(v)]) for _, v in sorted(curves.items())]
        pca = Pca(comps, np.array([r["lambda"] for r in eig]), np.array([r["ratio"] for r in eig]),
                  header["k"], np.array(header["pca_mean"]))
        ae = None
        if header.get("ae"):
            a = header["ae"]
            ae = {"sizes": a["sizes"], "params": a["params"], "curves": [Curve(m, p) for m, p in a["curves"]]}
        return DriftModel(header["features"], np.array([r["mean"] for r in sc]), np.array([r["std"] for r in sc]),
                          header["n_ref"], pca, np.array(header["m2_ref"]), header["s2_ref"], cl,
                          header["calibration"], header["fraction"], ae)


# --------------------------------------------------------------------------- M5
def fit(reference: DataFrame, cols: Sequence[str], fraction: float | int = 0.90,
        calibration: str = "permute", repetitions: int = REPETITIONS, seed: int = 42,
        row_key: Sequence[str] | None = None, build_ae: bool = False, ae_params: dict | None = None) -> DriftModel:
    """M5: one G1 pass → scaler (A12) and scaled covariance → PCA by fraction
    (M6) → calibration curves (M8).

    ``calibration="permute"`` permutes the cells of the whole reference
    ``repetitions`` times on Spark, which gives as many curves.  ``"expected"``
    uses the closed form of their expectation: no extra pass, one curve, and
    other scores than the ten curves outside the calibrated range.
    """
    cols = list(cols)
    # one pass: raw moments give the scaler (mean, population std) and, scaled
    # on the driver, the covariance of the standardised reference
    raw = group_moments(reference, cols)[GROUP_ALL]
    mean, std, n = raw.mean, raw.std_pop, int(round(raw.n))
    mom = raw.scaled(mean, std)
    scaled = scale_columns(reference, cols, mean, std, keep=list(row_key or []))
    pca = pca_by_fraction(mom, fraction)
    m2 = mom.second_moment_about(pca.mean)
    s2 = float(np.trace(mom.second_moment_about(np.zeros(len(cols)))) / len(cols))
    model = DriftModel(cols, mean, std, n, pca, m2, s2, calibration=calibration, fraction=fraction)
    if calibration == "expected":
        mses = [expected_calibration_mse(m2, s2, pca.components, p) for p in LEVELS]
        model.curves = [Curve(mses, [p * 100 for p in LEVELS])]
    elif calibration == "permute":
        from windrift.plans.permute import calibration_table
        table = calibration_table(scaled, cols, list(row_key or []), pca.components, pca.mean,
                                  repetitions=repetitions, seed=seed).collect()
        reps: dict[int, list] = {}
        for r in table:
            reps.setdefault(r["rep"], []).append((r["perm_pct"], r["mse"]))
        model.curves = [Curve([m for _, m in sorted(v)], [p for p, _ in sorted(v)]) for _, v in sorted(reps.items())]
    else:
        raise ValueError(calibration)
    if build_ae:
        from windrift.plans.autoencoder import fit_autoencoder
        model.ae = fit_autoencoder(scaled, cols, model, ae_params or {}, seed=seed, row_key=row_key)
    return model


# --------------------------------------------------------------------------- M9, M10, F13
def abs_cosines(ref: np.ndarray, cur: np.ndarray) -> np.ndarray:
    """|cos| between rank-paired loading vectors."""
    k = min(len(ref), len(cur))
    num = np.abs(np.sum(ref[:k] * cur[:k], axis=1))
    den = np.linalg.norm(ref[:k], axis=1) * np.linalg.norm(cur[:k], axis=1)
    return np.where(den > 0, num / np.where(den > 0, den, 1.0), 0.0)


def dp_score(model: DriftModel, cur: Moments) -> tuple[float, int, float]:
    """M9: returns (dP, k of the current PCA, smallest eigen gap of current)."""
    pc = pca_by_fraction(cur, model.fraction)
    k = min(model.pca.k, pc.k)
    lam = model.pca.eigenvalues[:k]
    cos = abs_cosines(model.pca.components, pc.components)
    denom = float(lam.sum())
    dp = 100.0 * (1.0 - float(np.sum(lam * cos[:k])) / denom) if denom > 0 else 0.0
    return max(dp, 0.0), pc.k, pc.min_gap   # |cos| ≤ 1: below 0 is rounding only


def de_pca_score(model: DriftModel, cur: Moments) -> tuple[float | None, float]:
    """(dE_PCA, mse)."""
    m2 = cur.second_moment_about(model.pca.mean)
    mse = reconstruction_mse(m2, model.pca.components)
    score, _ = curve_scores(model.curves, mse)
    return score, mse


def curve_spread(curves: Sequence[Curve], mse: float) -> tuple[int, float | None, float | None, bool]:
    """(usable curves, their smallest and largest clipped value, whether ``mse``
    lies outside the calibrated range of any curve)."""
    vals = [v for c in curves if (v := curve_scores([c], mse)[0]) is not None]
    outside = any(not (min(c.mse) <= mse <= max(c.mse)) for c in curves if c.mse)
    return len(vals), min(vals, default=None), max(vals, default=None), outside


SCORE_SCHEMA = T.StructType([
    T.StructField("grp", T.StringType()), T.StructField("n_rows", T.LongType()),
    T.StructField("dp", T.DoubleType()), T.StructField("de_pca", T.DoubleType()),
    T.StructField("de_ae", T.DoubleType()), T.StructField("mse_pca", T.DoubleType()),
    T.StructField("k_ref", T.IntegerType()), T.StructField("k_cur", T.IntegerType()),
    T.StructField("degenerate", T.BooleanType()), T.StructField("min_eigen_gap", T.DoubleType()),
    T.StructField("n_curves", T.IntegerType()), T.StructField("curve_min", T.DoubleType()),
    T.StructField("curve_max", T.DoubleType()), T.StructField("extrapolated", T.BooleanType()),
    T.StructField("n_dropped", T.LongType()),
])


def score_moments(model: DriftModel, moments: dict[str, Moments], ae_mse: dict[str, float] | None = None,
                  compat_zero: bool = False) -> list[tuple]:
    rows = []
    for g in sorted(moments, key=lambda g: (g is None, g)):
        m = moments[g]
        dp, k_cur, gap = dp_score(model, m)
        de, mse = de_pca_score(model, m)
        if de is None and compat_zero:
            de = 0.0
        de_ae = None
        if model.ae is not None and ae_mse is not None and g in ae_mse:
            from windrift.plans.autoencoder import ae_score
            de_ae = ae_score(model, ae_mse[g])
        n_curves, low, high, outside = curve_spread(model.curves, mse)
        rows.append((g, int(round(m.n)), float(dp), de, de_ae, float(mse), model.pca.k, int(k_cur),
                     model.degenerate, float(gap) if np.isfinite(gap) else None, n_curves, low, high, outside,
                     int(round(m.dropped))))
    return rows


def _score_rows(model: DriftModel, compat_zero: bool):
    """Executor side of ``score``: packed moments of each group → its scores."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            moments = {g: m for g, vec in zip(pdf["grp"], pdf["g"])
                       if (m := unpack_moments(vec, model.d).scaled(model.mean, model.std)).n > 0}
            ae = {g: float(m.sums[1] / m.sums[2]) for g, m in moments.items() if len(m.sums) == 3 and m.sums[2] > 0}
            rows = score_moments(model, moments, ae, compat_zero)
            rows += [(g, 0, *[None] * 13, int(unpack_moments(vec, model.d).dropped))
                     for g, vec in zip(pdf["grp"], pdf["g"]) if g not in moments]
            yield pd.DataFrame(rows, columns=[f.name for f in SCORE_SCHEMA.fields])

    return run


def score(model: DriftModel, current: DataFrame, group: str | None = None, compat_zero: bool = False) -> DataFrame:
    """All metrics for the current data, one row per group, as a
    lazy DataFrame.

    One G1 pass over the current data gives every group's packed moments;
    the scores (reference scaling, eigen decomposition, curves) are computed
    by the executors from those rows, so the number of groups is not bounded
    by the driver.  The autoencoder error, when a model has one, is summed in
    that same pass.
    """
    table = moments_table(current, model.features, group, more=_ae_sums(model))
    return table.mapInPandas(_score_rows(model, compat_zero), SCORE_SCHEMA)


def _ae_sums(model: DriftModel):
    if model.ae is None:
        return None
    from windrift.plans.autoencoder import error_sums
    return error_sums(model)


def score_scenarios(model: DriftModel, df: DataFrame, keys: Sequence[str], scenarios=None, seed: int = 42) -> DataFrame:
    """All metrics of every scenario's version of ``df``, one row per scenario.  One pass over the rows: the task makes
    the versions of a block and sums the moments and the autoencoder's errors of each."""
    from windrift.operators.inject import SCENARIOS, scenario_variants
    variants, given = scenario_variants(df, model.features, keys, scenarios or SCENARIOS, seed)
    table = moments_table(df, model.features, more=_ae_sums(model), variants=variants, given=given)
    return table.mapInPandas(_score_rows(model, False), SCORE_SCHEMA)


def gram_table(df: DataFrame, cols: Sequence[str], group: str | None = None,
               mean: np.ndarray | None = None, std: np.ndarray | None = None,
               ref_group: str | None = None) -> DataFrame:
    """G1 as a table ``(grp, i, j, v)`` of sums over standardised features.

    One grouped moments pass over the raw data, whose small table is kept; the scaler
    is either given, or taken from the ``ref_group`` group of it (the only row that
    reaches the driver).  The executors turn every group's row to its sums."""
    import pandas as pd

    from windrift.session import cut_lineage

    d = len(cols)
    table = cut_lineage(moments_table(df, cols, group))
    if mean is None or std is None:
        base = collect_moments(table.filter(F.col("grp") == F.lit(ref_group if ref_group is not None else GROUP_ALL)), d)
        base = base[ref_group if ref_group is not None else GROUP_ALL]
        mean, std = base.mean, base.std_pop
    i, j = np.triu_indices(d + 1)

    def rows(batches):
        for pdf in batches:
            for g, vec in zip(pdf["grp"], pdf["g"], strict=True):
                m = unpack_moments(vec, d)
                if m.n > 0:
                    yield pd.DataFrame({"grp": g, "i": i, "j": j, "v": m.scaled(mean, std).raw_sums()[i, j]})

    return table.mapInPandas(rows, "grp string, i int, j int, v double")


def with_loadings(model: DriftModel, components: np.ndarray, curves: Sequence[Curve] | None = None) -> DriftModel:
    """The model with given unit loadings (k × d), and curves, in place of the fitted ones; its scaler stays."""
    pca = Pca(np.asarray(components, float), model.pca.eigenvalues, model.pca.ratios, len(components), model.pca.mean)
    return replace(model, pca=pca, curves=list(model.curves if curves is None else curves))
