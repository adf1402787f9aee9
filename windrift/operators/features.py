"""Vector assembly, variance filtering and PCA with Spark ML (M1-M4).

Spark ML fits both the variance summary and the PCA covariance with tree
aggregation on the executors; only a d-vector and a d×d matrix reach the
driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import PCA, VarianceThresholdSelector, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrift.functions.columns import qcol
from windrift.operators.prep import width_suffix

# The feature list the PCA stage asks for.  Seven of them are
# not produced by the windowed stage and are skipped (D12).  Stems, without the
# suffix of the window width.
PCA_STEMS = [
    "avg_traffic_volume_gbyte", "sum_traffic_volume_gbyte",
    "avg_erab_drop_rate", "avg_erab_estab_attempts", "avg_erab_setup_success_rate",
    "avg_rrc_users", "avg_rrc_estab_success_rate", "avg_rrc_attempts",
    "avg_sim_rrc_conn_count", "avg_pusch_rrc_count", "sum_pusch_rrc_count",
    "avg_dl_prb_utilization", "avg_ul_prb_utilization",
    "avg_ul_interference", "max_ul_interference", "min_ul_interference",
    "avg_ul_rssi_dbm", "avg_ul_rssi_pusch_dbm",
    "avg_volte_traffic_erl", "avg_ho_success_rate", "avg_mac_dl_ibler",
    "avg_mac_ul_ibler", "avg_rsrp_pusch", "avg_rsrp_pucch", "avg_cqi",
]


def pca_features(width: str = "8 hours") -> list[str]:
    """The features the PCA stage asks for, named for a window width."""
    return [f"{stem}_{width_suffix(width)}" for stem in PCA_STEMS]


PCA_FEATURES = pca_features()
PCA_K = 2


def assemble(df: DataFrame, cols: Sequence[str], out: str = "features", handle_invalid: str = "error") -> DataFrame:
    """M1: columns → one vector column (``handle_invalid``: error/skip/keep, D21)."""
    renamed = df
    safe = []
    for c in cols:  # VectorAssembler cannot read dotted names: give them plain aliases
        if any(ch in c for ch in ".`"):
            alias = "_v_" + "".join(ch if ch.isalnum() else "_" for ch in c)
            renamed = renamed.withColumn(alias, qcol(c))
            safe.append(alias)
        else:
            safe.append(c)
    va = VectorAssembler(inputCols=list(safe), outputCol=out, handleInvalid=handle_invalid)
    res = va.transform(renamed)
    extra = [s for s, c in zip(safe, cols) if s != c]
    return res.drop(*extra) if extra else res


def variance_table(df: DataFrame, cols: Sequence[str], threshold: float = 0.0) -> DataFrame:
    """M2 (SQL form): sample variance per feature and whether it survives
    (``variance > threshold``, strictly, D15).  One aggregate pass, then a
    stack to long form; order column ``j`` keeps the input order."""
    aggs = [F.var_samp(qcol(c)).alias(f"_v{j}") for j, c in enumerate(cols)]
    wide = df.agg(*aggs)
    stack = ", ".join(f"{j}, '{c}', _v{j}" for j, c in enumerate(cols))
    long = wide.selectExpr(f"stack({len(cols)}, {stack}) as (j, feature, variance)")
    return long.withColumn("kept", F.coalesce(F.col("variance") > F.lit(float(threshold)), F.lit(False)))


@dataclass
class SelectionResult:
    frame: DataFrame
    kept: list[str]
    model: object


def variance_filter(df: DataFrame, cols: Sequence[str], in_col: str = "features", out_col: str = "vt_features",
                    threshold: float = 0.0, require_any: bool = True) -> SelectionResult:
    """M2: ``VarianceThresholdSelector`` on the assembled vector; survivors are
    listed by name.  Raises when nothing survives (an empty vector cannot be
    fed to PCA)."""
    vt = VarianceThresholdSelector(featuresCol=in_col, outputCol=out_col, varianceThreshold=threshold)
    model = vt.fit(df)
    kept = [cols[i] for i in model.selectedFeatures]
    if require_any and not kept:
        raise ValueError("no feature has variance above the threshold")
    return SelectionResult(model.transform(df), kept, model)


@dataclass
class PcaResult:
    frame: DataFrame
    k: int
    explained: list[float]
    loadings: list[list[float]]   # k rows of d loadings (canonical signs)
    model: object


def pca_project(df: DataFrame, n_features: int, k: int = PCA_K, in_col: str = "vt_features",
                out_col: str = "features", canonical_sign: bool = True) -> PcaResult:
    """M3 + M4: Spark ML PCA to ``min(k, surviving features)`` components.

    Spark centres for the covariance but projects the uncentred vector (D17),
    kept as is.  With ``canonical_sign`` every component is flipped so its
    largest-magnitude loading is positive (D18); the flip is applied to the
    projected column with array arithmetic, still JVM-side.
    """
    k_eff = max(1, min(k, n_features))
    model = PCA(k=k_eff, inputCol=in_col, outputCol=out_col).fit(df)
    pc = model.pc.toArray()  # d × k
    signs = []
    for a in range(k_eff):
        col = pc[:, a]
        idx = int(abs(col).argmax())
        signs.append(-1.0 if col[idx] < 0 else 1.0)
    out = model.transform(df)
    if canonical_sign and any(s < 0 for s in signs):
        sign_arr = F.array(*[F.lit(s) for s in signs])
        arr = vector_to_array(F.col(out_col))
        out = out.withColumn(out_col, array_to_vector(F.zip_with(arr, sign_arr, lambda x, s: x * s)))
    loadings = [[float(pc[j, a] * signs[a]) for j in range(pc.shape[0])] for a in range(k_eff)]
    explained = [float(x) for x in model.explainedVariance.toArray()]
    return PcaResult(out, k_eff, explained, loadings, model)


def explained_variance_table(spark, result: PcaResult) -> DataFrame:
    """M4: ``(component, ratio)``."""
    return spark.createDataFrame([(a + 1, r) for a, r in enumerate(result.explained)],
                                 "component int, ratio double")


@dataclass
class MlReady:
    frame: DataFrame        # window_start, window_end, CELL, N_CELL, features
    valid: list[str]
    missing: list[str]
    kept: list[str]
    pca: PcaResult


def ml_ready(windowed: DataFrame, wanted: Sequence[str] = PCA_FEATURES, k: int = PCA_K,
             threshold: float = 0.0, strict: bool = False, materialize: bool = True) -> MlReady:
    """The second preparation stage: features ∩ available → assemble →
    variance filter → PCA → ``(window, CELL, N_CELL, features)``.

    The variance fit, the PCA fit and the final transform each read the
    assembled frame; with ``materialize`` it is checkpointed once to the
    shared folder, so its upstream (e.g. the windowed aggregation over the
    raw KPI rows) runs once instead of three times."""
    available = set(windowed.columns)
    valid = [c for c in wanted if c in available]
    missing = [c for c in wanted if c not in available]
    if strict and missing:
        raise ValueError(f"missing features: {missing}")
    if not valid:
        raise ValueError("no valid feature found in the input")
    assembled = assemble(windowed.select("window_start", "window_end", "CELL", "N_CELL", *valid), valid,
                         "temp_features").select("window_start", "window_end", "CELL", "N_CELL", "temp_features")
    if materialize:
        from windrift.session import cut_lineage
        assembled = cut_lineage(assembled)
    sel = variance_filter(assembled, valid, "temp_features", "vt_features", threshold)
    pca = pca_project(sel.frame, len(sel.kept), k)
    final = pca.frame.select("window_start", "window_end", "CELL", "N_CELL", "features")
    return MlReady(final, valid, missing, sel.kept, pca)
