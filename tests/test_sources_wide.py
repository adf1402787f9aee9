"""Wide KPI rows, their report, salted joins, malformed lines, plans."""

import re
import tempfile

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from windrift import registry_jobs, registry_prep
from windrift.operators import features as feat
from windrift.operators import prep
from windrift.sources import fixtures as fx
from windrift.sources import readers


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_wide_rows_have_all_sources(spark):
    kpi = fx.kpi_wide(spark, SF_SMALL)
    present, missing = prep.resolve_spec(kpi, prep.FULL_SPEC)
    assert len(present) == 25 and not missing
    w = prep.windowed_features(kpi, None, prep.FULL_SPEC, "4 hours")
    valid, _ = prep.select_features(w, feat.pca_features("4 hours"))
    assert len(valid) == 18 and all(c.endswith("_4h") for c in valid)


def test_report_counts_values_in_the_same_pass(spark):
    kpi = fx.kpi_wide(spark, SF_SMALL)
    seen = Observation("t")
    w = prep.windowed_features(kpi, None, prep.FULL_SPEC, observation=seen)
    w.write.format("noop").mode("overwrite").save()
    report = {r.source: r for r in prep.feature_report(spark, kpi.columns, prep.FULL_SPEC, "8h", seen).collect()}
    for source in ("Avg_CQI_HWI", "L.UL.Interference.Max", "UL_PRB_Util_%"):
        n = kpi.filter(F.col(f"`{source}`").isNotNull()).count()
        assert report[source].present and report[source].n_values == n < kpi.count()


def test_report_names_absent_sources(spark):
    narrow = fx.kpi_from_events(spark, SF_SMALL)
    rows = prep.feature_report(spark, narrow.columns, prep.FULL_SPEC, "8h").collect()
    assert sum(r.present for r in rows) == 4 and len(rows) == 25 and all(r.n_values is None for r in rows if r.present)


def test_events_are_read_twice_for_windows_with_neighbours(spark):
    scans = re.findall(r"FileScan parquet", _plan(registry_prep.q_a1(spark, SF_SMALL)))
    assert len(scans) == 2  # the KPI rows and the cells


@pytest.mark.parametrize("how", ["auto", "merge", "salted"])
def test_a_hot_cell_through_every_join(spark, how):
    """One cell holds a third of all rows; it has neighbours, some cells have none, one neighbour is listed twice."""
    n = 3000
    kpi = spark.range(n).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50 + 100).cast("int").alias("CELL"),
                                F.col("id").alias("v"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("w"))
    nb = spark.createDataFrame([(7, 8), (7, 9), (7, 9), (101, 7), (None, 3)], "CELL int, N_CELL int")
    out = prep.join_neighbours(kpi, nb, how=how)
    want = []
    listed = {7: [8, 9, 9], 101: [7]}
    for i in range(n):
        c = 7 if i % 3 == 0 else i % 50 + 100
        want += [(c, i, i if i % 5 else None, x) for x in listed.get(c, [None])]
    assert _rows(out) == sorted(want, key=repr)


def test_salted_join_spreads_a_hot_cell(spark):
    kpi = spark.range(0, 4000, 1, 4).select(F.lit(7).alias("CELL"), F.col("id").alias("v"))
    nb = spark.createDataFrame([(7, 8)], "CELL int, N_CELL int")
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "32")
        sizes = prep.join_neighbours(kpi, nb, how="salted").groupBy(F.spark_partition_id()).count().collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(sizes) > 6 and max(r["count"] for r in sizes) < 2000


def test_neighbour_lists_are_bounded_and_symmetric(spark):
    ov = {(r.CELL, r.N_CELL) for r in fx.overlap_from_events(spark, SF_SMALL).collect()}
    cells = {r.user_id for r in fx.table(spark, SF_SMALL, "events").select("user_id").distinct().collect()}
    assert ov == {(a, b) for a in cells for b in cells if 0 < abs(a - b) <= 3}


def test_malformed_lines_are_counted_whatever_the_query_reads(spark):
    base = tempfile.mkdtemp(prefix="windrift-bad-")
    lines = ["DATETIME,CELL,CARRIER", "2024-01-01 00:00:00,a,1", "2024-01-01 00:00:00,b,x", "never,c,2", "2024-01-01 00:00:00,d", ",,"]
    spark.createDataFrame([(x,) for x in lines], "v string").coalesce(1).write.mode("overwrite").text(f"{base}/f")
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("DATETIME", T.TimestampType()), T.StructField("CELL", T.StringType()),
                           T.StructField("CARRIER", T.IntegerType()), T.StructField(readers.CORRUPT, T.StringType())])
    k = readers.read_kpi_csv(spark, f"{base}/f", schema, keep_corrupt=True)
    assert tuple(prep.kpi_quality(k).first()) == (5, 2, 1, 3)
    assert {r[0] for r in k.filter(F.col(readers.CORRUPT).isNotNull()).select(readers.CORRUPT).collect()} == set(lines[2:5])


def test_x1_joins_neighbours_above_the_state(spark):
    from windrift.streaming import jobs as sj
    ev = sj.file_stream(spark, SF_SMALL, "events.parquet")
    nb = prep.neighbour_pairs(fx.overlap_from_events(spark, SF_SMALL))
    out = sj.windowed_stream(fx.kpi_rows(ev), nb, prep.BASIC_SPEC)
    plan = out._jdf.queryExecution().analyzed().toString()
    join, watermark = plan.index("Join LeftOuter"), plan.index("EventTimeWatermark")
    assert join < plan.index("Aggregate", join) < watermark  # printed from the top: join, aggregate, watermark


def test_stream_leaves_the_shuffle_setting_alone(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    assert registry_jobs.q_x1(spark, SF_SMALL).count() > 0
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
