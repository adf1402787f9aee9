"""Edge cases: time zone, fill modes, no usable curve, full KPI schema."""

import os

import pytest
from pyspark.sql import functions as F

from windrift.operators import prep
from windrift.plans import detector as det
from windrift.sources import fixtures as fx
from windrift.sources import readers
from windrift.sources.schemas import KPI_FIELDS, PRB_COUNT, kpi_schema
from tests.conftest import SF_SMALL


def test_buckets_do_not_move_with_session_zone(spark):
    kpi = fx.kpi_from_events(spark, SF_SMALL)
    nb = prep.neighbour_pairs(prep.filter_overlap(fx.overlap_from_events(spark, SF_SMALL), 40.0))
    base = sorted(tuple(r) for r in prep.windowed_features(kpi, nb, prep.BASIC_SPEC, exact_scale=2).collect())
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Istanbul")
        other = sorted(tuple(r) for r in prep.windowed_features(kpi, nb, prep.BASIC_SPEC, exact_scale=2).collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert base == other  # shipped timestamps are timestamp_ntz: wall-clock buckets


def test_fill_modes(spark):
    df = spark.createDataFrame([(1, None, 1.0), (2, 4.0, None), (3, 2.0, 3.0)], "CELL int, a double, b double")
    mean = {r["CELL"]: r for r in prep.fill_features(df, "mean").collect()}
    assert mean[1]["a"] == pytest.approx(3.0) and mean[2]["b"] == pytest.approx(2.0)
    none = {r["CELL"]: r for r in prep.fill_features(df, "none").collect()}
    assert none[1]["a"] is None


def test_no_usable_curve_gives_null_or_zero(spark):
    li = fx.lineitem_features(spark, SF_SMALL)
    ref, cur = fx.split_ref_current(li)
    m = det.fit(ref, fx.LINEITEM_FEATURES)
    m.curves = []
    assert det.score(m, cur).first()["de_pca"] is None
    assert det.score(m, cur, compat_zero=True).first()["de_pca"] == 0.0


def test_full_kpi_schema_csv_through_all_features(spark, tmp_dir):
    """The KPI rows written with the declared 145-column header (the fixture
    fills three measures, the rest stay empty) read back with the declared
    schema and aggregated with the whole 25-feature spec."""
    kpi = fx.kpi_from_events(spark, SF_SMALL)
    schema = kpi_schema()
    assert len(schema.fields) == len(KPI_FIELDS) + PRB_COUNT == 145
    cols = []
    for f in schema.fields:
        if f.name == "DATETIME":
            cols.append(F.date_format("DATETIME", "yyyy-MM-dd HH:mm:ss").alias(f.name))
        elif f.name == "CELL":
            cols.append(F.col("CELL").cast("string").alias(f.name))
        elif f.name in kpi.columns:
            cols.append(F.col(f.name).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    path = os.path.join(tmp_dir, "kpi_full")
    kpi.select(*cols).write.option("header", True).csv(path)
    back = readers.read_kpi_csv(spark, path)
    assert back.columns == [f.name for f in schema.fields]
    ov = fx.overlap_from_events(spark, SF_SMALL).select(F.col("CELL").cast("string"), F.col("N_CELL").cast("string"),
                                                         "Overlap_Alan%")
    nb = prep.neighbour_pairs(prep.filter_overlap(ov, 40.0))
    w = prep.fill_numeric_zero(prep.windowed_features(back, nb, prep.FULL_SPEC))
    feats = prep.feature_columns(w)
    assert len(feats) == 25 and "max_ul_interference_8h" in feats
    row = w.agg(*[F.sum(c).alias(c) for c in ("avg_cqi_8h", "avg_traffic_volume_gbyte_8h")]).first()
    assert row["avg_cqi_8h"] == 0.0 and row["avg_traffic_volume_gbyte_8h"] > 0
    assert w.filter(F.col("N_CELL").isNull()).count() > 0   # string keys: NULL neighbour kept


def test_stream_windows_in_non_utc_session(spark, tmp_dir):
    from windrift.streaming import jobs as sj
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Istanbul")
        ev = sj.file_stream(spark, SF_SMALL, "events.parquet")
        out = sj.windowed_stream(fx.kpi_rows(ev), None, prep.BASIC_SPEC, "8 hours", "8 hours", exact_scale=2)
        sj.run_to_parquet(out, os.path.join(tmp_dir, "s"), os.path.join(tmp_dir, "c"))
        streamed = spark.read.parquet(os.path.join(tmp_dir, "s"))
        hours = {r["h"] for r in streamed.select(F.hour("window_start").alias("h")).distinct().collect()}
        assert hours <= {0, 8, 16}
        batch = prep.windowed_features(fx.kpi_from_events(spark, SF_SMALL), None, prep.BASIC_SPEC, exact_scale=2)
        keys = ["window_start", "CELL"]
        j = streamed.join(batch.select(*keys, F.col("avg_traffic_8h").alias("b")), keys)
        assert j.count() == streamed.count() > 0
        assert j.filter(F.col("avg_traffic_8h") != F.col("b")).count() == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_quality_counts(spark):
    df = spark.createDataFrame([(None, 1), ("2024-01-01 00:00:00", None), ("2024-01-01 01:00:00", 2)],
                               "t string, CELL int").select(F.col("t").cast("timestamp").alias("DATETIME"), "CELL")
    r = prep.kpi_quality(df).first()
    assert (r["n_rows"], r["null_time"], r["null_cell"], r["corrupt"]) == (3, 1, 1, 0)


def test_readers_permissive_index_and_single_csv(spark, tmp_dir):
    from pyspark.sql import types as T
    path = os.path.join(tmp_dir, "kpi.csv")
    with open(path, "w") as fh:
        fh.write("DATETIME,CELL,Traffic_Volume_Gbyte\n2024-01-01 00:00:00,a,1.5\nnot-a-time,b,oops\n")
    schema = T.StructType([T.StructField("DATETIME", T.TimestampType()), T.StructField("CELL", T.StringType()),
                           T.StructField("Traffic_Volume_Gbyte", T.DoubleType()),
                           T.StructField("_corrupt_record", T.StringType())])
    df = readers.read_kpi_csv(spark, path, schema, keep_corrupt=True)
    q = prep.kpi_quality(df).first()
    assert q["n_rows"] == 2 and q["corrupt"] == 1 and q["null_time"] == 1
    ov = os.path.join(tmp_dir, "ov.csv")
    with open(ov, "w") as fh:
        fh.write("Unnamed: 0,CELL,N_CELL,Overlap_Alan%\n0,a,b,55.0\n1,a,c,12.5\n")
    sch = T.StructType([T.StructField("Unnamed: 0", T.IntegerType()), T.StructField("CELL", T.StringType()),
                        T.StructField("N_CELL", T.StringType()), T.StructField("Overlap_Alan%", T.DoubleType())])
    o = readers.read_overlap_csv(spark, ov, sch)
    assert o.columns == ["CELL", "N_CELL", "Overlap_Alan%"]
    assert [r["N_CELL"] for r in prep.filter_overlap(o, 40.0).collect()] == ["b"]
    out = os.path.join(tmp_dir, "one")
    readers.write_single_csv(prep.top_neighbours(o, 10), out)
    assert len([f for f in os.listdir(out) if f.endswith(".csv")]) == 1
