"""The forest over counted cells against the one that Spark ML fits row by row."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from windrift.operators import forest, models


def _frame(spark, n, seed, parts, constant=False, classes=3):
    rng = np.random.default_rng(seed)
    a, b = np.round(rng.normal(size=n), 2), rng.integers(0, 6, n).astype(float)
    c = np.zeros(n) if constant else np.where(rng.random(n) < 0.5, 0.0, np.round(rng.exponential(size=n), 1))
    y = np.clip((a + 0.3 * b + c + 0.3 * rng.normal(size=n)).round(), 0, classes - 1)
    rows = [tuple(map(float, r)) for r in zip(a, b, c, y, strict=True)]
    frame = spark.createDataFrame(spark.sparkContext.parallelize(rows, parts), "a double, b double, c double, y double")
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(frame)


def _spark_fit(frame, trees, seed):
    return RandomForestClassifier(featuresCol="features", labelCol="y", numTrees=trees, seed=seed).fit(frame)


def _shape(model):
    return model.toDebugString.split("\n")[1:]


@pytest.mark.parametrize(("n", "trees", "seed", "parts", "constant"), [(12_500, 40, 42, 3, False), (400, 4, 7, 2, True), (9, 5, 1, 1, False)])
def test_trees_are_those_of_spark_ml(spark, monkeypatch, n, trees, seed, parts, constant):
    """Same splits, leaves and predictions, grown from fewer cells than rows and one table of draws for all levels."""
    frame = _frame(spark, n, seed, parts, constant)
    made, real = [], forest._cells
    monkeypatch.setattr(forest, "_cells", lambda *a: made.append(real(*a)) or made[-1])
    monkeypatch.setattr(forest, "BLOCK_ROWS", 3000)
    got, want = models.fit_forest(frame, "features", "y", trees, seed), _spark_fit(frame, trees, seed)
    assert _shape(got) == _shape(want)
    assert (got.getNumTrees, got.numClasses, got.numFeatures) == (want.getNumTrees, want.numClasses, want.numFeatures)
    a, b = (m.transform(frame).select("a", "b", "c", "rawPrediction", "prediction").collect() for m in (got, want))
    assert a == b
    assert len(made) == 1  # the rows were walked once, not at every level
    cells = made[0].select((F.length("codes") / 8).alias("n")).agg(F.sum("n")).first()[0]
    assert cells <= n if n < 100 else cells < n


def test_generators_are_those_of_the_jvm(spark):
    jvm = spark.sparkContext._jvm
    for seed in (0, 42, -3, 1 << 40):
        java, xor = jvm.java.util.Random(seed), jvm.org.apache.spark.util.random.XORShiftRandom(seed)
        mine, shift = forest._JavaRandom(seed), forest._XorShift(seed)
        assert [mine.next_long() for _ in range(5)] == [java.nextLong() for _ in range(5)]
        assert [shift.next_double() for _ in range(5)] == [xor.nextDouble() for _ in range(5)]
        assert [shift.next(32) for _ in range(5)] == [xor.nextInt() for _ in range(5)]


def test_what_cells_cannot_hold_is_left_to_spark_ml(spark):
    frame = _frame(spark, 300, 2, 2)
    assert forest._fit_cells(frame, "features", "y", 1, 42) is None
    assert _shape(models.fit_forest(frame, "features", "y", 1, 42)) == _shape(_spark_fit(frame, 1, 42))
    for label in (F.lit(-1.0), F.lit(0.5), F.lit(None).cast("double")):  # Spark refuses these
        bad = frame.withColumn("y", F.when(F.col("b") == 1, label).otherwise(F.col("y")))
        assert forest._fit_cells(bad, "features", "y", 3, 42) is None
        with pytest.raises(Exception):  # noqa: B017
            models.fit_forest(bad, "features", "y", 3, 42)
    assert forest._fit_cells(frame.limit(0), "features", "y", 3, 42) is None
