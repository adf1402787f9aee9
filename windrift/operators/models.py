"""Supervised models with Spark ML."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrift.operators import forest
from windrift.operators.features import assemble
from windrift.operators.reshape import hash_split, keep_first_share


@dataclass
class RegressionResult:
    model: LinearRegressionModel
    rmse: float
    r2: float


def fit_linear(df: DataFrame, features: Sequence[str], label: str, handle_invalid: str = "error") -> RegressionResult:
    """Ordinary least squares (normal-equation solver: one pass for the
    Gram matrix on the executors), with rmse and r2 on the training data."""
    data = assemble(df, features, "features", handle_invalid).select("features", F.col(label).cast("double").alias("label"))
    lr = LinearRegression(featuresCol="features", labelCol="label", solver="normal")
    model = lr.fit(data)
    return RegressionResult(model, float(model.summary.rootMeanSquaredError), float(model.summary.r2))


def numeric_features(df: DataFrame, label: str) -> list[str]:
    """The int, double and float columns but the label (bigint keys are none)."""
    return [c for c, t in df.dtypes if t in ("int", "double", "float") and c != label]


def coefficient_table(spark: SparkSession, features: Sequence[str], model: LinearRegressionModel) -> DataFrame:
    """One ``(feature, coefficient, intercept)`` row per feature."""
    rows = [(f, float(c), float(model.intercept)) for f, c in zip(features, model.coefficients, strict=True)]
    return spark.createDataFrame(rows, "feature string, coefficient double, intercept double")


def fit_forest(train: DataFrame, features_col: str, label: str, trees: int = 100, seed: int = 42
               ) -> RandomForestClassificationModel:
    """Random forest, 100 trees, fixed seed; the trees of Spark ML, grown over counted cells (``forest``)."""
    return forest.fit_forest(train, features_col, label, trees, seed)


def accuracy(model, test: DataFrame, label: str) -> DataFrame:
    """Share of held-out rows whose prediction equals the label (one
    aggregate, stays a DataFrame)."""
    pred = model.transform(test)
    return pred.agg(F.avg((F.col("prediction") == F.col(label).cast("double")).cast("double")).alias("accuracy"),
                    F.count(F.lit(1)).alias("n_test"))


def retrain_comparison(df: DataFrame, features_col: str, label: str, keys: Sequence[str],
                       share: float = 0.7, trees: int = 100, seed: int = 42) -> DataFrame:
    """Train on all training rows and on the first ``share`` of them
    (seeded hash order), test both on the same held-out rows →
    ``(run, n_train, accuracy, n_test)``."""
    split = hash_split(df, keys, 0.8, seed)
    train, test = split.filter("is_train"), split.filter(~F.col("is_train"))
    n_train = train.count()
    reduced = keep_first_share(train, share, keys, seed, n=n_train)
    out = []
    for run, tr in (("original", train), ("changed", reduced)):
        m = fit_forest(tr, features_col, label, trees, seed)
        out.append(accuracy(m, test, label).select(F.lit(run).alias("run"), F.lit(tr.count()).alias("n_train"),
                                                   "accuracy", "n_test"))
    return out[0].unionByName(out[1])


def save_model(model, path: str) -> None:
    """Spark ML persistence (portable, no pickling of JVM objects)."""
    model.write().overwrite().save(path)


def load_linear(path: str) -> LinearRegressionModel:
    return LinearRegressionModel.load(path)
