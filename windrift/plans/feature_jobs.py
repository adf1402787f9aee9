"""The two preparation jobs, chained through Parquet (S6-S8), with their
run records in the ledger.

Job 1: KPI rows + overlap → threshold → neighbours → windowed features →
fill → partitioned Parquet.  Job 2: windowed Parquet → feature check and drift
means → assemble → variance filter → PCA → ML-ready Parquet.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession

from windrift.operators import features as feat
from windrift.operators import prep
from windrift.plans.ledger import Ledger
from windrift.sources import readers


def report_path(out_path: str) -> str:
    """Where job 1 leaves ``prep.feature_report`` of its output."""
    return out_path.rstrip("/") + "_report"


def windowed_job(spark: SparkSession, kpi: DataFrame, overlap: DataFrame, out_path: str, ledger: Ledger | None = None,
                 threshold: float = 40.0, width: str = "8 hours", spec: Sequence[prep.FeatureSpec] = prep.FULL_SPEC,
                 fill: str = "zero", exact_scale: int | None = None, parent_run_id: str | None = None) -> str | None:
    """Job 1.  Returns the run id when a ledger is given."""
    def body(run):
        if run:
            for k, v in (("overlap_threshold_pct", threshold), ("window_width", width), ("fill", fill)):
                run.param(k, v)
        k = prep.harmonize_names(kpi)
        nb = prep.neighbour_pairs(prep.filter_overlap(overlap, threshold))
        seen = Observation("sources")
        w = prep.windowed_features(k, nb, spec, width, exact_scale=exact_scale, observation=seen)
        w = prep.fill_features(w, fill)
        readers.write_windowed_parquet(w, out_path)
        report = prep.feature_report(spark, k.columns, spec, prep.width_suffix(width), seen)
        report.write.mode("overwrite").parquet(report_path(out_path))
        if run:
            missing = sorted({x.source for x in spec} - set(k.columns))
            run.param("missing_sources", missing)
            run.metric("features_present", sum(x.source not in missing for x in spec))
            run.metric("features_missing", sum(x.source in missing for x in spec))
            run.artifact("feature_report", report_path(out_path))
            run.param("success", "yes")
            run.param("total_metrics_count", len(w.columns))
            run.artifact("windowed_features", out_path)
        return None

    if ledger is None:
        body(None)
        return None
    with ledger.run("windowed_features", parent_run_id) as run:
        body(run)
        return run.run_id


def ml_ready_job(spark: SparkSession, in_path: str, out_path: str, ledger: Ledger | None = None,
                 wanted: Sequence[str] | None = None, k: int = feat.PCA_K, threshold: float = 0.0,
                 parent_run_id: str | None = None, width: str = "8 hours") -> feat.MlReady:
    """Job 2.  The windowed table is read once per fit pass; it is far smaller
    than the raw KPI rows."""
    windowed = readers.read_stage_parquet(spark, in_path, "the windowed feature job")

    def body(run):
        means = prep.drift_means(windowed, width).first()
        res = feat.ml_ready(windowed, wanted or feat.pca_features(width), k, threshold)
        readers.write_vectors_parquet(res.frame, out_path)
        if run:
            run.param("pca_explained_variance", res.pca.explained)
            run.param("missing_features", res.missing)
            run.metric("drift_avg_traffic", means["traffic"])
            run.metric("drift_avg_drop_rate", means["drop"])
            run.gauge("feature_count", len(res.valid))
            run.gauge("pca_features_count", res.pca.k)
            run.gauge(f"avg_traffic_{prep.width_suffix(width)}", means["traffic"])
            run.gauge(f"avg_erab_drop_rate_{prep.width_suffix(width)}", means["drop"])
            run.artifact("ml_ready", out_path)
        return res

    if ledger is None:
        return body(None)
    with ledger.run("ml_ready", parent_run_id) as run:
        return body(run)
