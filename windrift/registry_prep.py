"""Registered queries for the preparation operators, each with its DuckDB
oracle.  Keys are the operator ids of the survey inventory."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from windrift.functions.columns import or_zero, qcol
from windrift.operators import prep
from windrift.session import scratch_path
from windrift.sources import fixtures as fx
from windrift.sources import readers

THRESHOLD = 40.0
WIDTH = "8 hours"
EXACT = 2  # KPI values in the fixture are fixed-point with two decimals

# ----------------------------------------------------------------- oracle CTEs
KPI_SQL = """kpi AS (
  SELECT ts AS DATETIME, CAST(user_id AS INTEGER) AS CELL, value AS Traffic_Volume_Gbyte,
         CASE WHEN event_type = 'error' THEN CAST(100 AS DOUBLE)
              WHEN event_type <> 'view' THEN CAST(0 AS DOUBLE) END AS ERAB_Drop_PC,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS Nof_Avg_SimRRC_ConnUsr
  FROM events)"""
OVERLAP_SQL = """cells AS (SELECT DISTINCT CELL FROM kpi),
overlap AS (
  SELECT a.CELL AS CELL, b.CELL AS N_CELL,
         CAST(CASE WHEN a.CELL % 7 = 0 THEN (a.CELL * 37 + b.CELL * 11) % 40
                   ELSE (a.CELL * 37 + b.CELL * 11) % 61 END AS DOUBLE) AS "Overlap_Alan%"
  FROM cells a JOIN cells b ON a.CELL <> b.CELL AND abs(a.CELL - b.CELL) <= 3),
nb AS (SELECT CELL, N_CELL FROM overlap WHERE "Overlap_Alan%" >= 40)"""
BASE = f"WITH {KPI_SQL},\n{OVERLAP_SQL}"
WIDE_SQL = (KPI_SQL[:KPI_SQL.index("\n  FROM")] + ",\n         "
            + ",\n         ".join(f'CAST({e} AS DOUBLE) AS "{n}"' for n, e in fx.WIDE_SOURCES.items())
            + "\n  FROM events LEFT JOIN orders ON o_orderkey = event_id LEFT JOIN lineitem ON l_orderkey = event_id)")
BASE_WIDE = f"WITH {WIDE_SQL},\n{OVERLAP_SQL}"


def _avg_sql(col: str, alias: str, fill: bool) -> str:
    e = f'CAST(SUM(CAST("{col}" AS DECIMAL(18,2))) AS DOUBLE) / NULLIF(COUNT("{col}"), 0)'
    return f"{'COALESCE(' + e + ', 0)' if fill else e} AS {alias}"


def _sum_sql(col: str, alias: str, fill: bool) -> str:
    e = f'CAST(SUM(CAST("{col}" AS DECIMAL(18,2))) AS DOUBLE)'
    return f"{'COALESCE(' + e + ', 0)' if fill else e} AS {alias}"


def _windowed_sql(spec_rows: list[tuple[str, str, str]], fill: bool, base: str = BASE, hours: int = 8) -> str:
    aggs = ",\n  ".join(_avg_sql(src, alias, fill) if agg == "avg" else _sum_sql(src, alias, fill)
                        for alias, src, agg in spec_rows)
    return f"""{base},
j AS (
  SELECT time_bucket(INTERVAL '{hours} hours', k.DATETIME, TIMESTAMP '1970-01-01') AS ws, k.*, nb.N_CELL
  FROM kpi k LEFT JOIN nb ON k.CELL = nb.CELL WHERE k.DATETIME IS NOT NULL)
SELECT ws AS window_start, ws + INTERVAL '{hours} hours' AS window_end, CELL, N_CELL,
  {aggs}
FROM j GROUP BY ws, CELL, N_CELL"""


def _spec_rows(spec, suffix: str = "8h") -> list[tuple[str, str, str]]:
    return [(s.alias(suffix), s.source, s.agg) for s in spec]


# ----------------------------------------------------------------- Spark side
def _kpi(spark, d):
    return fx.kpi_from_events(spark, d)


def _nb(spark, d):
    return prep.neighbour_pairs(prep.filter_overlap(fx.overlap_from_events(spark, d), THRESHOLD))


def q_a1(spark: SparkSession, d: str) -> DataFrame:
    w = prep.windowed_features(_kpi(spark, d), _nb(spark, d), prep.BASIC_SPEC, WIDTH, exact_scale=EXACT)
    return prep.fill_numeric_zero(w)


def _full(spark, d, width=WIDTH, **more):
    return prep.windowed_features(fx.kpi_wide(spark, d), _nb(spark, d), prep.FULL_SPEC, width, exact_scale=EXACT, **more)


def q_a2(spark: SparkSession, d: str) -> DataFrame:
    return _full(spark, d)


def q_a2_literal(spark: SparkSession, d: str) -> DataFrame:
    return _full(spark, d, mode="literal")


def q_a2_4h(spark: SparkSession, d: str) -> DataFrame:
    return _full(spark, d, "4 hours")


def _report(spark, kpi, nb):
    """The report of one windowed job: its counts come from the pass that writes the features."""
    seen = Observation("sources")
    w = prep.windowed_features(kpi, nb, prep.FULL_SPEC, WIDTH, exact_scale=EXACT, observation=seen)
    readers.write_windowed_parquet(prep.fill_numeric_zero(w), scratch_path(spark, f"windowed-{uuid.uuid4().hex[:10]}"))
    return prep.feature_report(spark, kpi.columns, prep.FULL_SPEC, prep.width_suffix(WIDTH), seen)


def q_a2_report(spark: SparkSession, d: str) -> DataFrame:
    return _report(spark, fx.kpi_wide(spark, d), _nb(spark, d))


def q_a2_report_narrow(spark: SparkSession, d: str) -> DataFrame:
    """The same with KPI rows that have 3 of the 24 sources: 21 are reported as absent."""
    return _report(spark, _kpi(spark, d), _nb(spark, d))


def q_p6(spark: SparkSession, d: str) -> DataFrame:
    return prep.fill_numeric_zero(q_a2(spark, d))


def q_p3(spark, d):
    return prep.filter_overlap(fx.overlap_from_events(spark, d), THRESHOLD)


def q_p4(spark, d):
    return _nb(spark, d)


def q_j1(spark, d):
    return prep.join_neighbours(_kpi(spark, d), q_p3(spark, d))


def q_j1_merge(spark, d):
    return prep.join_neighbours(_kpi(spark, d), q_p3(spark, d), how="merge")


def q_j1_salted(spark, d):
    return prep.join_neighbours(_kpi(spark, d), q_p3(spark, d), how="salted")


def q_j2_salted(spark, d):
    return prep.join_overlap_whole(_kpi(spark, d), fx.overlap_from_events(spark, d), how="salted")


def q_j2(spark, d):
    return prep.join_overlap_whole(_kpi(spark, d), fx.overlap_from_events(spark, d))


def q_w1(spark, d):
    return prep.add_time_bucket(_kpi(spark, d), "DATETIME", WIDTH)


def q_a3(spark, d):
    return prep.fanout_totals(_kpi(spark, d), fx.overlap_from_events(spark, d), exact_scale=EXACT)


def q_a3_unjoined(spark, d):
    k = _kpi(spark, d)
    return k.agg(F.sum(F.col("Traffic_Volume_Gbyte").cast("decimal(18,2)")).cast("double").alias("total_traffic"),
                 (F.sum(F.col("ERAB_Drop_PC").cast("decimal(18,2)")).cast("double")
                  / F.nullif(F.count("ERAB_Drop_PC"), F.lit(0))).alias("avg_drop_rate"),
                 (F.sum(F.col("Nof_Avg_SimRRC_ConnUsr").cast("decimal(18,2)")).cast("double")
                  / F.nullif(F.count("Nof_Avg_SimRRC_ConnUsr"), F.lit(0))).alias("avg_users"))


def q_a4(spark, d):
    return prep.drift_means(q_p6(spark, d)).select(F.round("traffic", 6).alias("traffic"), F.round("drop", 6).alias("drop"))


def q_a5(spark, d):
    return prep.neighbour_overlap_avg(fx.overlap_from_events(spark, d)) \
        .withColumn("avg_overlap_pct", F.round("avg_overlap_pct", 6))


def q_t1(spark, d):
    return prep.top_neighbours(fx.overlap_from_events(spark, d), 10) \
        .withColumn("avg_overlap_pct", F.round("avg_overlap_pct", 6))


def q_a6(spark, d):
    return prep.global_overlap_avg(fx.overlap_from_events(spark, d)) \
        .withColumn("avg_overlap_pct", F.round("avg_overlap_pct", 6))


def q_a7(spark, d):
    return prep.row_count(_kpi(spark, d))


def q_a8(spark, d):
    return prep.column_sum(_kpi(spark, d), "Nof_Avg_SimRRC_ConnUsr", "total_users")


def q_a9(spark, d):
    return prep.shape(q_p6(spark, d))


def _renamed_kpi(spark, d):
    return (_kpi(spark, d).withColumnRenamed("CELL", "SectorID")
            .withColumnRenamed("Traffic_Volume_Gbyte", "Traffic Volume Gbyte"))


def q_p1(spark, d):
    return prep.harmonize_names(_renamed_kpi(spark, d))


def q_p2(spark, d):
    k = prep.rename_if_present(_renamed_kpi(spark, d), "SectorID", "CELL")
    k = prep.rename_if_present(k, "Traffic Volume Gbyte", "Traffic_Volume_Gbyte")
    return prep.rename_if_present(k, "NoSuchColumn", "Other")


def q_p5(spark, d):
    k = _kpi(spark, d).withColumnRenamed("Traffic_Volume_Gbyte", "L.UL.Interference.Avg") \
        .withColumnRenamed("ERAB_Drop_PC", "DL_PRB_Util_%_HWI") \
        .withColumnRenamed("Nof_Avg_SimRRC_ConnUsr", "E-RAB_SETUP_SUCCESS_RATE")
    return k.groupBy("CELL").agg(
        F.sum(qcol("L.UL.Interference.Avg").cast("decimal(18,2)")).cast("double").alias("sum_interference"),
        F.count(qcol("DL_PRB_Util_%_HWI")).alias("n_prb_util"),
        F.max(qcol("E-RAB_SETUP_SUCCESS_RATE")).alias("max_setup_rate"))


def q_p7(spark, d):
    from windrift.operators.features import assemble
    w = q_p6(spark, d)
    feats = prep.feature_columns(w)
    from pyspark.ml.functions import vector_to_array
    arr = vector_to_array("features")
    return prep.project_ml_ready(assemble(w, feats, "features")) \
        .select("window_start", "window_end", "CELL", "N_CELL", *[arr[i].alias(f"f{i}") for i in range(len(feats))])


def q_p9(spark, d):
    li = fx.table(spark, d, "lineitem")
    feats, label = prep.numeric_columns(li)
    return li.select(*feats, label)


def _wanted(w, width=WIDTH):
    from windrift.operators.features import pca_features
    return prep.select_features(w, pca_features(width))


def q_p10(spark, d):
    w = q_p6(spark, d)
    return w.select("window_start", "CELL", "N_CELL", *_wanted(w)[0])


def q_p10_4h(spark, d):
    w = prep.fill_numeric_zero(q_a2_4h(spark, d))
    return w.select("window_start", "CELL", "N_CELL", *_wanted(w, "4 hours")[0])


def q_p10_report(spark, d):
    return _wanted(q_p6(spark, d))[1]


def q_p11(spark, d):
    w = q_p6(spark, d)
    return w.select(*prep.feature_columns(w))


def q_p13(spark, d):
    return prep.drop_first_column(_kpi(spark, d))


def q_p8(spark, d):
    from pyspark.ml.functions import vector_to_array
    from windrift.operators.features import assemble
    li = fx.table(spark, d, "lineitem")
    feats, label = prep.numeric_columns(li)
    v = prep.project_features_label(assemble(li, feats, "features"), "features", label)
    arr = vector_to_array("features")
    return v.select(*[arr[i].alias(f"f{i}") for i in range(len(feats))], label)


def q_p12(spark, d):
    """Hourly drop rate per cell: hours holding only view events have a NULL
    mean, reported as 0."""
    w = prep.add_time_bucket(_kpi(spark, d), "DATETIME", "1 hour")
    return w.groupBy("window_start", "CELL").agg(or_zero(F.avg("ERAB_Drop_PC")).alias("avg_drop_rate"))


def q_f1(spark, d):
    from windrift.functions.columns import parse_timestamp
    k = _kpi(spark, d).select("CELL", F.date_format("DATETIME", "yyyy-MM-dd HH:mm:ss").alias("txt"))
    return k.select("CELL", parse_timestamp("txt").cast("timestamp_ntz").alias("DATETIME"))


QUERIES = {
    "P8": q_p8, "P12": q_p12, "F1": q_f1,
    "A1": q_a1, "A2": q_a2, "A2_literal": q_a2_literal, "P6": q_p6, "P3": q_p3, "P4": q_p4,
    "A2_4h": q_a2_4h, "A2_report": q_a2_report, "A2_report_narrow": q_a2_report_narrow,
    "P10_4h": q_p10_4h, "P10_report": q_p10_report, "J1_merge": q_j1_merge, "J1_salted": q_j1_salted, "J2_salted": q_j2_salted,
    "J1": q_j1, "J2": q_j2, "W1": q_w1, "A3": q_a3, "A3_unjoined": q_a3_unjoined, "A4": q_a4,
    "A5": q_a5, "T1": q_t1, "A6": q_a6, "A7": q_a7, "A8": q_a8, "A9": q_a9,
    "P1": q_p1, "P2": q_p2, "P5": q_p5, "P7": q_p7, "P9": q_p9, "P10": q_p10, "P11": q_p11, "P13": q_p13,
}

# ----------------------------------------------------------------- oracle SQL
_FULL_ROWS = _spec_rows(prep.FULL_SPEC)
_BASIC_ROWS = _spec_rows(prep.BASIC_SPEC)
_A2_SQL = _windowed_sql(_FULL_ROWS, False, BASE_WIDE)
_P6_SQL = _windowed_sql(_FULL_ROWS, True, BASE_WIDE)
_P6_4H_SQL = _windowed_sql(_spec_rows(prep.FULL_SPEC, "4h"), True, BASE_WIDE, 4)
_KPI_COLS_SQL = "DATETIME, CELL, Traffic_Volume_Gbyte, ERAB_Drop_PC, Nof_Avg_SimRRC_ConnUsr"

ORACLE = {
    "A1": _windowed_sql(_BASIC_ROWS, fill=True),
    "A2": _A2_SQL,
    "A2_literal": _A2_SQL,
    "P6": _P6_SQL,
    "P3": f'{BASE} SELECT CELL, N_CELL, "Overlap_Alan%" FROM overlap WHERE "Overlap_Alan%" >= 40',
    "P4": f"{BASE} SELECT CELL, N_CELL FROM nb",
    "J1": f"{BASE} SELECT k.CELL, k.DATETIME, k.Traffic_Volume_Gbyte, k.ERAB_Drop_PC, "
          f"k.Nof_Avg_SimRRC_ConnUsr, nb.N_CELL FROM kpi k LEFT JOIN nb ON k.CELL = nb.CELL",
    "J2": f'{BASE} SELECT k.CELL, k.DATETIME, k.Traffic_Volume_Gbyte, k.ERAB_Drop_PC, '
          f'k.Nof_Avg_SimRRC_ConnUsr, o.N_CELL, o."Overlap_Alan%" FROM kpi k LEFT JOIN overlap o ON k.CELL = o.CELL',
    "W1": f"{BASE} SELECT {_KPI_COLS_SQL}, "
          f"time_bucket(INTERVAL '8 hours', DATETIME, TIMESTAMP '1970-01-01') AS window_start, "
          f"time_bucket(INTERVAL '8 hours', DATETIME, TIMESTAMP '1970-01-01') + INTERVAL '8 hours' AS window_end "
          f"FROM kpi WHERE DATETIME IS NOT NULL",
    "A3": f"""{BASE}, f AS (SELECT k.* FROM kpi k LEFT JOIN overlap o ON k.CELL = o.CELL)
SELECT CAST(SUM(CAST(Traffic_Volume_Gbyte AS DECIMAL(18,2))) AS DOUBLE) AS total_traffic,
  {_avg_sql('ERAB_Drop_PC', 'avg_drop_rate', False)}, {_avg_sql('Nof_Avg_SimRRC_ConnUsr', 'avg_users', False)} FROM f""",
    "A3_unjoined": f"""{BASE} SELECT CAST(SUM(CAST(Traffic_Volume_Gbyte AS DECIMAL(18,2))) AS DOUBLE) AS total_traffic,
  {_avg_sql('ERAB_Drop_PC', 'avg_drop_rate', False)}, {_avg_sql('Nof_Avg_SimRRC_ConnUsr', 'avg_users', False)} FROM kpi""",
    "A5": f'{BASE} SELECT N_CELL, ROUND(AVG("Overlap_Alan%"), 6) AS avg_overlap_pct FROM overlap GROUP BY N_CELL',
    "T1": f'{BASE} SELECT N_CELL, ROUND(AVG("Overlap_Alan%"), 6) AS avg_overlap_pct FROM overlap GROUP BY N_CELL '
          f'ORDER BY avg_overlap_pct DESC, N_CELL ASC LIMIT 10',
    "A6": f'{BASE} SELECT ROUND(AVG("Overlap_Alan%"), 6) AS avg_overlap_pct FROM overlap',
    "A7": f"{BASE} SELECT COUNT(*) AS n_rows FROM kpi",
    "A8": f"{BASE} SELECT SUM(Nof_Avg_SimRRC_ConnUsr) AS total_users FROM kpi",
    "A9": f"WITH w AS ({_P6_SQL}) SELECT COUNT(*) AS n_rows, CAST({4 + len(_FULL_ROWS)} AS INTEGER) AS n_columns FROM w",
    "P1": f"{BASE} SELECT {_KPI_COLS_SQL} FROM kpi",
    "P2": f"{BASE} SELECT {_KPI_COLS_SQL} FROM kpi",
    "P5": f"""{BASE} SELECT CELL, CAST(SUM(CAST(Traffic_Volume_Gbyte AS DECIMAL(18,2))) AS DOUBLE) AS sum_interference,
  COUNT(ERAB_Drop_PC) AS n_prb_util, MAX(Nof_Avg_SimRRC_ConnUsr) AS max_setup_rate FROM kpi GROUP BY CELL""",
    "P9": "SELECT l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem",
    "P13": f"{BASE} SELECT CELL, Traffic_Volume_Gbyte, ERAB_Drop_PC, Nof_Avg_SimRRC_ConnUsr FROM kpi",
    "P8": ("SELECT CAST(l_linenumber AS DOUBLE) AS f0, l_quantity AS f1, l_extendedprice AS f2, l_discount AS f3, "
           "l_tax FROM lineitem"),
    "P12": f"""{BASE} SELECT time_bucket(INTERVAL '1 hour', DATETIME, TIMESTAMP '1970-01-01') AS window_start, CELL,
  COALESCE(AVG(ERAB_Drop_PC), 0.0) AS avg_drop_rate FROM kpi
  WHERE DATETIME IS NOT NULL GROUP BY 1, 2""",
    "F1": f"{BASE} SELECT CELL, date_trunc('second', DATETIME) AS DATETIME FROM kpi",
}
# A4 needs its own aggregate over the filled windows
ORACLE["A4"] = (f"WITH w AS ({_P6_SQL}) SELECT ROUND(COALESCE(AVG(avg_traffic_volume_gbyte_8h), 0), 6) AS traffic, "
                f"ROUND(COALESCE(AVG(avg_erab_drop_rate_8h), 0), 6) AS drop FROM w")


# The stems that the PCA stage asks for and the windowed stage does not make.
_NOT_MADE = ["avg_pusch_rrc_count", "sum_pusch_rrc_count", "avg_ul_rssi_dbm", "avg_ul_rssi_pusch_dbm", "avg_ho_success_rate",
             "avg_mac_dl_ibler", "avg_mac_ul_ibler"]


def _pca_stems() -> list[str]:
    from windrift.operators.features import PCA_STEMS
    return [c for c in PCA_STEMS if c not in _NOT_MADE]


def _p10_sql(sql: str, suffix: str) -> str:
    return f"WITH w AS ({sql}) SELECT window_start, CELL, N_CELL, {', '.join(f'{c}_{suffix}' for c in _pca_stems())} FROM w"


def _p10_report_sql() -> str:
    from windrift.operators.features import PCA_STEMS
    return "SELECT * FROM (VALUES " + ", ".join(f"('{c}_8h', {str(c not in _NOT_MADE).lower()})" for c in PCA_STEMS) + ") t(feature, present)"


def _report_sql(base: str, have) -> str:
    return base + " " + " UNION ALL ".join(
        f"SELECT '{a}' AS feature, '{src}' AS source, {str(src in have).lower()} AS present, "
        + (f'(SELECT COUNT("{src}") FROM kpi)' if src in have else "0") + " AS n_values" for a, src, _ in _FULL_ROWS)


def _p11_sql() -> str:
    return f"WITH w AS ({_P6_SQL}) SELECT {', '.join(a for a, _, _ in _FULL_ROWS)} FROM w"


ORACLE["A2_4h"] = _windowed_sql(_spec_rows(prep.FULL_SPEC, "4h"), False, BASE_WIDE, 4)
ORACLE["A2_report"] = _report_sql(BASE_WIDE, {src for _, src, _ in _FULL_ROWS})
ORACLE["A2_report_narrow"] = _report_sql(BASE, {"Traffic_Volume_Gbyte", "ERAB_Drop_PC", "Nof_Avg_SimRRC_ConnUsr"})
ORACLE["J1_merge"] = ORACLE["J1_salted"] = ORACLE["J1"]
ORACLE["J2_salted"] = ORACLE["J2"]
ORACLE["P10"] = _p10_sql(_P6_SQL, "8h")
ORACLE["P10_4h"] = _p10_sql(_P6_4H_SQL, "4h")
ORACLE["P10_report"] = _p10_report_sql()
ORACLE["P7"] = (f"WITH w AS ({_P6_SQL}) SELECT window_start, window_end, CELL, N_CELL, "
                + ", ".join(f"{a} AS f{i}" for i, (a, _, _) in enumerate(_FULL_ROWS)) + " FROM w")
ORACLE["P11"] = _p11_sql()
