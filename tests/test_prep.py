"""Preparation operators: eager = literal, fan-out, fill, names, threshold."""

import math

import pytest
from pyspark.sql import functions as F

from windrift.operators import prep
from windrift.sources import fixtures as fx
from tests.conftest import SF_SMALL


def _rows(df, cols=None):
    cols = cols or df.columns
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_eager_equals_literal_with_duplicate_pairs(spark):
    kpi = fx.kpi_from_events(spark, SF_SMALL)
    ov = prep.filter_overlap(fx.overlap_from_events(spark, SF_SMALL), 40.0)
    dup = ov.unionByName(ov.filter(F.col("CELL") < 5))  # duplicated pairs multiply sums
    for exact in (None, 2):
        a = prep.windowed_features(kpi, dup, prep.FULL_SPEC, mode="eager", exact_scale=exact)
        b = prep.windowed_features(kpi, dup, prep.FULL_SPEC, mode="literal", exact_scale=exact)
        ra, rb = _rows(a), _rows(b)
        assert len(ra) == len(rb)
        for x, y in zip(ra, rb):
            for u, v in zip(x, y):
                if isinstance(u, float):
                    assert math.isclose(u, v, rel_tol=1e-12, abs_tol=1e-12)
                else:
                    assert u == v


def test_fan_out_and_null_neighbour(spark):
    kpi = fx.kpi_from_events(spark, SF_SMALL)
    ov = prep.filter_overlap(fx.overlap_from_events(spark, SF_SMALL), 40.0)
    j = prep.join_neighbours(kpi, ov)
    n_kpi = kpi.count()
    per_cell = {r["CELL"]: r["n"] for r in ov.groupBy("CELL").agg(F.count("*").alias("n")).collect()}
    expected = sum(max(1, per_cell.get(r["CELL"], 0)) for r in kpi.select("CELL").collect())
    assert j.count() == expected >= n_kpi
    # cells 0, 7, 14 have no neighbour at threshold 40 (fixture property)
    no_nb = {r["CELL"] for r in j.filter(F.col("N_CELL").isNull()).select("CELL").distinct().collect()}
    assert {0, 7, 14} <= no_nb


def test_threshold_inclusive_and_null_dropped(spark):
    ov = spark.createDataFrame([("a", "b", 40.0), ("a", "c", 39.99), ("a", "d", None)],
                               "CELL string, N_CELL string, `Overlap_Alan%` double")
    assert [r["N_CELL"] for r in prep.filter_overlap(ov, 40.0).collect()] == ["b"]


def test_fill_keeps_null_keys_and_turns_nan_to_zero(spark):
    df = spark.createDataFrame([(1, None, float("nan"), None), (2, 3, 1.5, 2.0)],
                               "CELL int, N_CELL int, a double, b double")
    out = {r["CELL"]: r for r in prep.fill_numeric_zero(df).collect()}
    assert out[1]["N_CELL"] is None and out[1]["a"] == 0.0 and out[1]["b"] == 0.0
    assert out[2]["a"] == 1.5


def test_harmonize_priority_and_noop(spark):
    df = spark.createDataFrame([(1, 2, 3.0)], "SectorID int, SITE int, `Traffic Volume Gbyte` double")
    out = prep.harmonize_names(df)
    assert "CELL" in out.columns and "SITE" in out.columns and "Traffic_Volume_Gbyte" in out.columns
    assert out.first()["CELL"] == 1
    df2 = spark.createDataFrame([(1,)], "CELL int")
    assert prep.harmonize_names(df2).columns == ["CELL"]
    assert prep.rename_if_present(df2, "nope", "x").columns == ["CELL"]


def test_width_suffix_and_window_alignment(spark):
    assert prep.width_suffix("8 hours") == "8h"
    assert prep.width_suffix("24 hours") == "24h"
    assert prep.width_suffix("1 day") == "1d"
    df = spark.createDataFrame([("2024-01-01 00:00:00",), ("2024-01-01 07:59:59",), ("2024-01-01 08:00:00",), (None,)],
                               "t string").select(F.col("t").cast("timestamp").alias("DATETIME"))
    b = prep.add_time_bucket(df, "DATETIME", "8 hours")
    assert b.count() == 3  # NULL time dropped (D6)
    starts = sorted({r["window_start"].hour for r in b.collect()})
    assert starts == [0, 8]


def test_spec_resolution_reports_missing(spark):
    kpi = fx.kpi_from_events(spark, SF_SMALL)
    present, missing = prep.resolve_spec(kpi, prep.FULL_SPEC)
    assert {s.source for s in present} == {"Traffic_Volume_Gbyte", "ERAB_Drop_PC", "Nof_Avg_SimRRC_ConnUsr"}
    assert "UL_PACKET_LOSS" in missing
    with pytest.raises(ValueError):
        prep.resolve_spec(kpi, prep.FULL_SPEC, strict=True)


def test_select_features_report(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    valid, report = prep.select_features(df, ["b", "z", "a"])
    assert valid == ["b", "a"]
    assert {r["feature"]: r["present"] for r in report.collect()} == {"b": True, "z": False, "a": True}
    with pytest.raises(ValueError):
        prep.select_features(df, ["z"])


def test_numeric_rule_excludes_bigint(spark):
    df = spark.createDataFrame([(1, 2, 3.0, 4)], "a int, b bigint, c double, d int")
    feats, label = prep.numeric_columns(df)
    assert feats == ["a", "c"] and label == "d"


def test_top_neighbours_tie_break(spark):
    ov = spark.createDataFrame([("x", "b", 50.0), ("x", "a", 50.0), ("x", "c", 10.0)],
                               "CELL string, N_CELL string, `Overlap_Alan%` double")
    assert [r["N_CELL"] for r in prep.top_neighbours(ov, 2).collect()] == ["a", "b"]


def test_bounded_broadcast_needs_a_known_size(spark):
    df = spark.range(1000)
    assert prep.bounded_broadcast(df) is df                                            # unknown: no hint, no job
    assert prep.bounded_broadcast(df, max_bytes=10, known_rows=1000) is df             # too big
    assert prep.bounded_broadcast(df, max_bytes=1 << 30, known_rows=1000) is not df    # small: hinted copy
