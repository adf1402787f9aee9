"""Bands, advice policies and scalar expressions."""

import pytest
from pyspark.sql import functions as F

from windrift.functions import bands
from windrift.functions.scalar import change_pct, clip, gaussian, signed_cbrt, standardize
from windrift.operators import inject


def test_band_edges(spark):
    vals = [0.0, 9.99, 10.0, 29.99, 30.0, 49.99, 50.0, 69.99, 70.0, 100.0, None]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    out = {r["v"]: r for r in df.select("v", bands.band("v", "dp").alias("dp"), bands.band("v", "verdict").alias("ver"),
                                        bands.band("v", "printer", missing_as_zero=True).alias("pr")).collect()}
    assert out[9.99]["dp"].startswith("Very Low") and out[10.0]["dp"].startswith("Low")
    assert out[70.0]["dp"].startswith("Very High")
    assert out[29.99]["ver"] == "confirmed" and out[30.0]["ver"] == "medium" and out[50.0]["ver"] == "high"
    assert out[None]["dp"] is None
    assert out[None]["pr"].startswith("Minor")   # D36: missing counts as 0


def test_scalar_expressions(spark):
    df = spark.createDataFrame([(-8.0, 0.0, 5.0)], "x double, r double, c double")
    r = df.select(signed_cbrt("x").alias("a"), clip(F.lit(120.0)).alias("b"), change_pct("c", "r").alias("p"),
                  standardize("x", -8.0, 0.0).alias("z")).first()
    assert r["a"] == pytest.approx(-2.0) and r["b"] == 100.0 and r["p"] is None and r["z"] == 0.0


def test_keyed_gaussian_is_stable_and_standard(spark):
    df = spark.range(20000)
    g = df.select(gaussian(1, "id").alias("g"))
    s = g.agg(F.avg("g").alias("m"), F.stddev("g").alias("s")).first()
    assert abs(s["m"]) < 0.03 and abs(s["s"] - 1) < 0.03
    a = [r["g"] for r in g.limit(5).collect()]
    b = [r["g"] for r in df.repartition(3).orderBy("id").select(gaussian(1, "id").alias("g")).limit(5).collect()]
    assert a == b


def test_choose_columns():
    cols = [f"c{i}" for i in range(8)]
    assert len(inject.choose_columns(cols, 0.0)) == 1
    assert len(inject.choose_columns(cols, 0.6)) == 4
    assert inject.choose_columns(cols, 0.4, 3) == inject.choose_columns(cols, 0.4, 3)
