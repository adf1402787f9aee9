"""Result tables of the drift detector (M15, U1, W2) and views of a fitted
model (M5, M6, M8, A15, F13).  Model views are small (≤ d² rows) and built
from the driver-side matrices; result tables stay DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windrift.functions import bands
from windrift.functions.scalar import clip
from windrift.plans import detector as det
from windrift.session import cut_lineage


def model_table(spark: SparkSession, model: det.DriftModel) -> DataFrame:
    """M5 summary: one row per feature with scaler values and the loadings of
    the kept components."""
    rows = []
    for j, f in enumerate(model.features):
        rows.append((j, f, float(model.mean[j]), float(model.std[j]), model.pca.k, model.n_ref,
                     [float(model.pca.components[a, j]) for a in range(model.pca.k)]))
    return spark.createDataFrame(rows, "j int, feature string, mean double, std double, k int, n_ref long, "
                                       "loadings array<double>")


def eigen_table(spark: SparkSession, model: det.DriftModel) -> DataFrame:
    """M6: ``(component, eigenvalue, ratio, cumulative, kept)``."""
    cum = np.cumsum(model.pca.ratios)
    rows = [(a + 1, float(model.pca.eigenvalues[a]), float(model.pca.ratios[a]), float(cum[a]), a < model.pca.k)
            for a in range(len(model.pca.eigenvalues))]
    return spark.createDataFrame(rows, "component int, eigenvalue double, ratio double, cumulative double, "
                                       "kept boolean")


def calibration_rows(spark: SparkSession, model: det.DriftModel) -> DataFrame:
    """M8: ``(rep, perm_pct, mse, guarded)`` of every calibration curve."""
    rows = []
    for r, c in enumerate(model.curves):
        _, guarded = det.make_increasing(c.mse)
        rows += [(r, float(p), float(m), bool(guarded)) for p, m in zip(c.pct, c.mse)]
    return spark.createDataFrame(rows, "rep int, perm_pct double, mse double, guarded boolean")


def curve_pieces(spark: SparkSession, model: det.DriftModel) -> DataFrame:
    """The splines as a table ``(rep, lo, hi, x, c0..c3)``: on [lo, hi) a curve is the cubic c0 + c1·(t-x) + ...; the end
    pieces go on without end.  Nine rows a curve."""
    rows = []
    for rep, curve in enumerate(model.curves):
        s = curve.spline()
        h = np.diff(s.x)
        c1 = np.diff(s.y) / h - h * (2 * s.sigma[:-1] + s.sigma[1:]) / 6
        c3 = np.diff(s.sigma) / (6 * h)
        lo, hi = [-np.inf, *s.x[1:-1]], [*s.x[1:-1], np.inf]
        rows += [(rep, *map(float, r)) for r in zip(lo, hi, s.x[:-1], s.y[:-1], c1, s.sigma[:-1] / 2, c3, strict=True)]
    return spark.createDataFrame(rows, "rep int, lo double, hi double, x double, c0 double, c1 double, c2 double, c3 double")


def curve_values(spark: SparkSession, model: det.DriftModel, scores: DataFrame) -> DataFrame:
    """Each curve's clipped estimate at every group's error, and their
    mean (the dE score).  The errors meet the pieces in an interval join; the pieces are as many as the curves have."""
    pieces = F.broadcast(curve_pieces(spark, model))
    met = scores.select("grp", "mse_pca").join(pieces, (F.col("mse_pca") >= F.col("lo")) & (F.col("mse_pca") < F.col("hi")))
    t = F.col("mse_pca") - F.col("x")
    value = F.col("c0") + t * (F.col("c1") + t * (F.col("c2") + t * F.col("c3")))
    return met.groupBy("grp").agg(F.avg(clip(value)).alias("de_pca"), F.count(F.lit(1)).alias("n_curves"))


def cosine_table(spark: SparkSession, model: det.DriftModel, current: DataFrame) -> DataFrame:
    """``(component, lambda_ref, abs_cos)`` for rank-paired components."""
    mom = det.group_moments(current, model.features)[det.GROUP_ALL].scaled(model.mean, model.std)
    pc = det.pca_by_fraction(mom, model.fraction)
    cos = det.abs_cosines(model.pca.components, pc.components)
    rows = [(a + 1, float(model.pca.eigenvalues[a]), float(cos[a])) for a in range(len(cos))]
    return spark.createDataFrame(rows, "component int, lambda_ref double, abs_cos double")


def result_report(scores: DataFrame, policy: str = "printer") -> DataFrame:
    """Long table ``(grp, metric, value, band, advice)``; the advice
    follows dE_PCA with a missing score counted as 0 (D36)."""
    long = scores.select("grp", "de_pca", F.expr(
        "stack(3, 'dP', dp, 'dE_PCA', de_pca, 'dE_AE', de_ae) as (metric, value)"))
    return (long.filter(F.col("value").isNotNull())
            .select("grp", "metric", "value", bands.metric_band("metric", "value").alias("band"),
                    bands.band("de_pca", policy, missing_as_zero=True).alias("advice")))


def write_history(result: DataFrame, path: str, run_id: str) -> None:
    """U1 (persistent): the rows of one run, in its own partition of the history.  A replay of the run replaces them, so
    the history never holds a run twice and none is read to add one."""
    result.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
        .partitionBy("run_id").parquet(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all runs, with their ``run_id``."""
    kept = T.StructType([*det.SCORE_SCHEMA.fields, T.StructField("run_id", T.StringType())])
    return spark.read.schema(kept).parquet(path)


def trend(result: DataFrame, order_col: str = "grp", metric: str = "de_pca", series: Sequence[str] = (),
          partitions: int | None = None) -> DataFrame:
    """Change of a score from the previous batch of its series.

    Rows are dealt in ranges of (series, order), and each range looks back inside
    itself; the last row of a range is carried to the next one that has rows, one row
    for each range.  So no series, however long, and no table passes through one task.
    Within equal keys the order is open; NULL keys come first.
    """
    keys = [*series, order_col]
    n = partitions or int(result.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = result.select(*keys, metric)
    ranged = cut_lineage(rows.repartitionByRange(n, *keys).withColumn("_part", F.spark_partition_id()))
    schema = T.StructType([T.StructField("_part", T.IntegerType()), *[T.StructField(f"_c_{k}", rows.schema[k].dataType) for k in series],
                           T.StructField("_carried", rows.schema[metric].dataType)])
    # a row for each range: its last one goes to the next range
    of_range = Window.partitionBy("_part").orderBy(*keys)
    last = ranged.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(*[F.desc(k) for k in keys])))
    ends = sorted(last.filter("_n = 1").drop("_n", order_col).collect(), key=lambda r: r["_part"])
    carried = [(b["_part"], *[a[k] for k in series], a[metric]) for a, b in zip(ends, ends[1:], strict=False)]
    carry = result.sparkSession.createDataFrame(carried, schema)
    same = F.lit(True)
    for k in series:
        same = same & F.col(f"_c_{k}").eqNullSafe(F.col(k))
    before = F.struct(*[F.col(k) for k in series], F.col(metric).alias("_v"))
    met = ranged.withColumn("_before", F.lag(before).over(of_range)).join(F.broadcast(carry), "_part", "left")
    inside = F.lit(True)
    for k in series:
        inside = inside & F.col(f"_before.{k}").eqNullSafe(F.col(k))
    prev = F.when(F.col("_before").isNotNull(), F.when(inside, F.col("_before._v"))).otherwise(F.when(same, F.col("_carried")))
    return met.select(*keys, metric, prev.alias(f"prev_{metric}"), (F.col(metric) - prev).alias(f"delta_{metric}"))
