"""Registered queries for models, the ledger, sources/sinks, the chained
jobs, streaming and the autoencoder."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrift.functions.columns import qcol
from windrift.operators import features as feat
from windrift.operators import models, prep
from windrift import registry_drift as rd
from windrift.plans import detector as det
from windrift.plans import report
from windrift.plans.feature_jobs import ml_ready_job, windowed_job
from windrift.plans.ledger import Ledger
from windrift.registry_prep import EXACT, THRESHOLD, WIDTH, q_p6
from windrift.session import scratch_path
from windrift.sources import fixtures as fx
from windrift.sources import readers
from windrift.sources.schemas import kpi_schema
from windrift.streaming import jobs as sj

SEED = 42


def _scratch(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:10]}")


# ----------------------------------------------------------------- models
def q_m18(spark: SparkSession, d: str) -> DataFrame:
    li = fx.table(spark, d, "lineitem")
    res = models.fit_linear(li, ["l_quantity"], "l_extendedprice")
    return models.coefficient_table(spark, ["l_quantity"], res.model).select(
        F.round("coefficient", 4).alias("slope"), F.round("intercept", 4).alias("intercept"),
        F.round(F.lit(res.rmse), 4).alias("rmse"), F.round(F.lit(res.r2), 6).alias("r2"))


def _fit_all(spark, d):
    """All numeric columns of lineitem but the label, as the reference fits them."""
    li = fx.table(spark, d, "lineitem")
    cols = models.numeric_features(li, "l_extendedprice")
    return cols, models.fit_linear(li, cols, "l_extendedprice")


def q_m18_all(spark, d):
    cols, res = _fit_all(spark, d)
    return models.coefficient_table(spark, cols, res.model).select(
        "feature", *[F.round(c, 4).alias(c) for c in ("coefficient", "intercept")],
        F.round(F.lit(res.rmse), 4).alias("rmse"), F.round(F.lit(res.r2), 6).alias("r2"))


#: The columns and the cuts of the class that the forests learn.
CLASS_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CLASS_CUTS = (30_000, 60_000)


def _classed(spark, d):
    """Line items with the class of their discounted price: it follows from two of the features, by a curved boundary."""
    li = fx.table(spark, d, "lineitem")
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    label = sum((price >= c).cast("double") for c in CLASS_CUTS)
    return feat.assemble(li.select(*fx.row_key_columns(), *CLASS_FEATURES).withColumn("label", label), CLASS_FEATURES, "features")


def _split_forest(spark, d):
    from windrift.operators.reshape import hash_split
    split = hash_split(_classed(spark, d), fx.ROW_KEY, 0.8, SEED)
    return models.fit_forest(split.filter("is_train"), "features", "label", 100, SEED), split.filter(~F.col("is_train"))


def q_m19(spark, d):
    m, test = _split_forest(spark, d)
    return m.transform(test).select(*fx.ROW_KEY, "label", "prediction")


def q_m20(spark, d):
    m, test = _split_forest(spark, d)
    return models.accuracy(m, test, "label")


def q_m21(spark, d):
    return models.retrain_comparison(_classed(spark, d), "features", "label", fx.ROW_KEY, 0.7, 100, SEED)


def q_s14(spark, d):
    li = fx.table(spark, d, "lineitem")
    res = models.fit_linear(li, ["l_quantity"], "l_extendedprice")
    path = _scratch(spark, "linear-model")
    models.save_model(res.model, path)
    back = models.load_linear(path)
    return spark.createDataFrame([(float(back.coefficients[0]), float(back.intercept))], "slope double, intercept double") \
        .select(F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"))


def q_s14_all(spark, d):
    cols, res = _fit_all(spark, d)
    path = _scratch(spark, "linear-model")
    models.save_model(res.model, path)
    return models.coefficient_table(spark, cols, models.load_linear(path)).select(
        "feature", *[F.round(c, 4).alias(c) for c in ("coefficient", "intercept")])


# ----------------------------------------------------------------- features M1-M4
def _filled(spark, d):
    return q_p6(spark, d)


def q_m1(spark, d):
    """Assembled vector, its positions spread to ``f0…`` columns."""
    from pyspark.ml.functions import vector_to_array
    w = _filled(spark, d)
    cols = prep.feature_columns(w)
    arr = vector_to_array("features")
    return feat.assemble(w, cols, "features").select("window_start", "CELL", "N_CELL",
                                                     *[arr[i].alias(f"f{i}") for i in range(len(cols))])


def q_m2(spark, d):
    w = _filled(spark, d)
    cols = [c for c in feat.PCA_FEATURES if c in w.columns]
    t = feat.variance_table(w, cols, 0.0)
    return t.select("j", "feature", F.round("variance", 1).alias("variance"), "kept")


#: Two windowed features, whose covariance has a closed form.
TWO_WINDOWED = ["avg_traffic_volume_gbyte_8h", "avg_rrc_users_8h"]


def q_m3_two(spark, d):
    from pyspark.ml.functions import vector_to_array
    res = feat.ml_ready(_filled(spark, d), TWO_WINDOWED)
    v = vector_to_array("features")
    return res.frame.select("window_start", "CELL", "N_CELL", *[(F.round(v[i], 4) + F.lit(0.0)).alias(f"f{i}") for i in range(2)])


def q_m4_two(spark, d):
    res = feat.ml_ready(_filled(spark, d), TWO_WINDOWED)
    return feat.explained_variance_table(spark, res.pca).select("component", F.round("ratio", 6).alias("ratio"))


def q_m3(spark, d):
    from pyspark.ml.functions import vector_to_array
    res = feat.ml_ready(_filled(spark, d))
    return res.frame.select("window_start", "window_end", "CELL", "N_CELL", vector_to_array("features").alias("features"))


def q_m4(spark, d):
    res = feat.ml_ready(_filled(spark, d))
    return feat.explained_variance_table(spark, res.pca)


# ----------------------------------------------------------------- sources and sinks
def _kpi_csv(spark, d) -> str:
    """The fixture KPI rows as CSV with the raw header variants (``SectorID``, ``Traffic Volume Gbyte``)."""
    path = _scratch(spark, "kpi-csv")
    kpi = fx.kpi_from_events(spark, d).withColumn("DATETIME", F.date_format("DATETIME", "yyyy-MM-dd HH:mm:ss")) \
        .withColumnRenamed("CELL", "SectorID").withColumnRenamed("Traffic_Volume_Gbyte", "Traffic Volume Gbyte")
    kpi.write.option("header", True).csv(path)
    return path


def _overlap_csv(spark, d) -> str:
    """The overlap relation as CSV with a leading index column."""
    path = _scratch(spark, "overlap-csv")
    ov = fx.overlap_from_events(spark, d)
    index = F.pmod(F.xxhash64("CELL", "N_CELL"), F.lit(1 << 30)).alias("_c0")
    ov.select(index, "CELL", "N_CELL", "Overlap_Alan%").write.option("header", True).csv(path)
    return path


#: Every so manyth event becomes a line with a wrong time, or with a measure that is no number.
BAD_TIME, BAD_VALUE = 101, 97


def _declared_csv(spark, d) -> str:
    """Events as lines of the declared 145 columns, some of them malformed: all columns are written as text."""
    path = _scratch(spark, "declared-csv")
    ev = fx.table(spark, d, "events")
    kpi = fx.kpi_rows(ev).columns
    made = dict(zip(kpi, fx.kpi_columns(), strict=True)) | {
        "DATETIME": F.when(F.col("event_id") % BAD_TIME == 0, "no time").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")),
        "Traffic_Volume_Gbyte": F.when(F.col("event_id") % BAD_VALUE == 0, "n/a").otherwise(F.col("value").cast("string")),
        "NUM_OF_RRC_Att": F.col("event_id")}
    none = F.lit(None).cast("string")
    ev.select(*[made.get(f.name, none).cast("string").alias(f.name) for f in kpi_schema().fields]) \
        .write.option("header", True).csv(path)
    return path


def q_s1(spark, d):
    k = prep.harmonize_names(readers.read_kpi_csv_inferred(spark, _kpi_csv(spark, d)))
    return k.select(F.col("DATETIME").cast("string").alias("DATETIME"), "CELL", "Traffic_Volume_Gbyte")


def q_s2(spark, d):
    """The declared 145 columns; a malformed field is NULL, the rest of its line stays."""
    k = readers.read_kpi_csv(spark, _declared_csv(spark, d))
    return k.select(F.col("DATETIME").cast("timestamp_ntz").alias("DATETIME"), *[qcol(f.name) for f in kpi_schema().fields[1:]])


def q_s2_corrupt(spark, d):
    """The malformed lines as they were read, with what could be kept of them."""
    k = readers.read_kpi_csv(spark, _declared_csv(spark, d), keep_corrupt=True)
    bad = k.filter(F.col("_corrupt_record").isNotNull())
    return bad.select("CELL", F.col("NUM_OF_RRC_Att").alias("event_id"), F.col("DATETIME").isNull().alias("bad_time"),
                      F.col("Traffic_Volume_Gbyte").isNull().alias("bad_value"),
                      F.size(F.split("_corrupt_record", ",")).alias("n_fields"),
                      F.split("_corrupt_record", ",")[0].alias("first_field"))


def q_d6(spark, d):
    return prep.kpi_quality(readers.read_kpi_csv(spark, _declared_csv(spark, d), keep_corrupt=True))


def q_s3(spark, d):
    return readers.read_overlap_csv(spark, _overlap_csv(spark, d))


def q_s4(spark, d):
    """Inferred columns, their types and their numbers of values."""
    df = readers.read_kpi_csv_inferred(spark, _kpi_csv(spark, d), None)
    counts = df.agg(*[F.count(qcol(c)).alias(f"n{j}") for j, c in enumerate(df.columns)])
    rows = [F.struct(F.lit(j).alias("j"), F.lit(c).alias("name"), F.lit(t).alias("type"), F.col(f"n{j}").alias("n_values"))
            for j, (c, t) in enumerate(df.dtypes)]
    return counts.select(F.inline(F.array(*rows)))


def q_s5(spark, d):
    """Weekly-cases shape: a date column then one numeric column per series."""
    base = _scratch(spark, "wide")
    kpi = fx.kpi_from_events(spark, d)
    kpi = kpi.withColumn("series", F.col("CELL") % fx.N_SERIES)
    wide = (kpi.groupBy(F.to_date("DATETIME").alias("date")).pivot("series", list(range(fx.N_SERIES)))
            .agg(F.sum(F.col("Traffic_Volume_Gbyte").cast("decimal(18,2)")).cast("double")))
    wide = wide.select(F.date_format("date", "dd/MM/yyyy").alias("date"),
                       *[F.col(str(i)).alias(f"c{i}") for i in range(fx.N_SERIES)])
    readers.write_single_csv(wide, base)
    back = readers.read_wide_series_csv(spark, base, date_format="dd/MM/yyyy")
    return back


def q_weekly_flow(spark, d):
    """The weekly-series analysis end to end: wide CSV (S5) → drop the date
    from the features (P13) → row-mean imputation (P15) → first half of the
    dates as reference (P16) → fit (M5) → score the second half (M14) →
    verdict band (F11)."""
    from windrift.functions import bands
    from windrift.operators.ordering import ordered_split
    from windrift.operators.reshape import row_mean_impute
    wide = q_s5(spark, d)
    series = prep.drop_first_column(wide).columns
    filled = row_mean_impute(wide, series)
    split = ordered_split(filled, ["date"], 0.5)
    model = det.fit(split.filter("is_ref"), series)
    res = det.score(model, split.filter(~F.col("is_ref")))
    return res.select("n_rows", "dp", "de_pca", "k_ref", "k_cur", "degenerate",
                      bands.band("de_pca", "verdict").alias("verdict"))


def q_s6_s8(spark, d):
    base = _scratch(spark, "jobs")
    led = Ledger(spark, os.path.join(base, "ledger"))
    rid = windowed_job(spark, fx.kpi_wide(spark, d), fx.overlap_from_events(spark, d),
                       os.path.join(base, "windowed"), led, THRESHOLD, WIDTH, exact_scale=EXACT)
    ml_ready_job(spark, os.path.join(base, "windowed"), os.path.join(base, "ml_ready"), led, parent_run_id=rid)
    return spark.read.parquet(os.path.join(base, "ml_ready"))


def q_s8(spark, d):
    """Both jobs through Parquet; the second on two features, whose projection has a closed form."""
    base = _scratch(spark, "jobs")
    windowed_job(spark, fx.kpi_wide(spark, d), fx.overlap_from_events(spark, d), os.path.join(base, "windowed"),
                 threshold=THRESHOLD, width=WIDTH, exact_scale=EXACT)
    ml_ready_job(spark, os.path.join(base, "windowed"), os.path.join(base, "ml_ready"), wanted=TWO_WINDOWED)
    back = spark.read.parquet(os.path.join(base, "ml_ready"))
    return back.select("window_start", "CELL", "N_CELL", *[(F.round(F.col("features")[i], 4) + F.lit(0.0)).alias(f"f{i}") for i in range(2)])


def q_s7(spark, d):
    base = _scratch(spark, "windowed")
    readers.write_windowed_parquet(q_p6(spark, d), base)
    return readers.read_stage_parquet(spark, base).drop("window_date")


def q_s9(spark, d):
    base = _scratch(spark, "single-csv")
    top = prep.top_neighbours(fx.overlap_from_events(spark, d), 10)
    readers.write_single_csv(top, base)
    return spark.read.option("header", True).schema("N_CELL int, avg_overlap_pct double").csv(base) \
        .withColumn("avg_overlap_pct", F.round("avg_overlap_pct", 6))


def q_s10(spark, d):
    # the whole nation dimension (fixed size) passes through the driver as rows
    n = fx.table(spark, d, "nation").select("n_nationkey", "n_name").collect()
    return readers.frame_from_rows(spark, [(r[0], r[1], float(r[0]) * 1.5) for r in n], "id long, name string, value double")


# ----------------------------------------------------------------- ledger
def _ledger_run(spark, d):
    base = _scratch(spark, "ledger")
    led = Ledger(spark, base)
    rid = windowed_job(spark, fx.kpi_wide(spark, d), fx.overlap_from_events(spark, d),
                       os.path.join(base, "windowed"), led, THRESHOLD, WIDTH, exact_scale=EXACT)
    ml_ready_job(spark, os.path.join(base, "windowed"), os.path.join(base, "ml_ready"), led, parent_run_id=rid)
    try:
        with led.run("failing_job", rid):
            raise ValueError("no valid feature found in the input")
    except ValueError:
        pass
    return led


def _steady(value, name):
    """A value as it is, but for times, of which only that they were taken."""
    return F.when(F.col(name) == "job_duration_seconds", (value > 0).cast("double")).otherwise(F.round(value, 6))


def q_s12(spark, d):
    return _ledger_run(spark, d).latest_gauges().select("job", "metric", _steady(F.col("value"), "metric").alias("value"))


def q_s13(spark, d):
    """Everything that was logged, long: params as text, metrics as numbers, artifacts by the last part of their path.  Of
    the explained variances, how many they are."""
    led = _ledger_run(spark, d)
    jobs = led.read("runs").select("run_id", "job")
    text = F.when(F.col("key") == "pca_explained_variance", F.size(F.split("value", ",")).cast("string")).otherwise(F.col("value"))
    nothing = F.lit(None).cast("double")
    params = led.read("params").select("run_id", F.lit("param").alias("kind"), "key", text.alias("text"), nothing.alias("number"))
    metrics = led.read("metrics").select("run_id", F.lit("metric").alias("kind"), "key", F.lit(None).cast("string").alias("text"),
                                         _steady(F.col("value"), "key").alias("number"))
    kept = led.read("artifacts").select("run_id", F.lit("artifact").alias("kind"), F.col("name").alias("key"),
                                        F.substring_index("path", "/", -1).alias("text"), nothing.alias("number"))
    return params.unionByName(metrics).unionByName(kept).join(jobs, "run_id").select("job", "kind", "key", "text", "number")


def q_o1(spark, d):
    return _ledger_run(spark, d).read("runs").select("job", "success", "error")


def q_o2(spark, d):
    """Duration of every run: it is the one logged as its metric, and lies within the run's start and end."""
    led = _ledger_run(spark, d)
    logged = led.read("metrics").filter("key = 'job_duration_seconds'").select("run_id", "value")
    between = F.unix_micros(F.to_utc_timestamp("ended_at", "UTC")) - F.unix_micros(F.to_utc_timestamp("started_at", "UTC"))
    return led.read("runs").join(logged, "run_id", "left").select(
        "job", (F.col("duration_s") > 0).alias("has_duration"), (F.col("duration_s") == F.col("value")).alias("is_logged"),
        (F.abs(between / 1e6 - F.col("duration_s")) < 30).alias("fits"))


def q_o3(spark, d):
    return _ledger_run(spark, d).lineage().select("job", "parent_job", "success")


# ----------------------------------------------------------------- streaming
def q_x1(spark, d):
    base = _scratch(spark, "stream-x1")
    side = sj.state_session(spark, 8)
    kpi = fx.kpi_rows(sj.file_stream(side, d, "events.parquet"))
    nb = prep.neighbour_pairs(prep.filter_overlap(fx.overlap_from_events(side, d), THRESHOLD))
    out = sj.windowed_stream(kpi, nb, prep.BASIC_SPEC, WIDTH, "8 hours", exact_scale=EXACT)
    sj.run_to_parquet(out, os.path.join(base, "sink"), os.path.join(base, "ckpt"))
    return spark.read.parquet(os.path.join(base, "sink"))


def _stream_scores(spark, d, model, history):
    stream = fx.lineitem_feature_rows(sj.file_stream(spark, d, "lineitem.parquet"), with_keys=True)
    sj.run_scoring_stream(stream, model, history, _scratch(spark, "stream-ckpt"), "batch")


def q_x2(spark, d):
    """Micro-batches of line items scored against the two-feature model."""
    hist = _scratch(spark, "history")
    _stream_scores(spark, d, rd.two_model(spark, d), hist)
    return report.read_history(spark, hist).select("run_id", "grp", "n_rows", F.round("mse_pca", 9).alias("mse_pca"))


def q_x2_full(spark, d):
    hist = _scratch(spark, "history")
    _stream_scores(spark, d, det.fit(fx.lineitem_features(spark, d).filter("is_ref"), fx.LINEITEM_FEATURES), hist)
    return report.read_history(spark, hist)


def q_u1(spark, d):
    """One history of the yearly batches and of the stream; both runs are replayed, which adds nothing."""
    hist, model = _scratch(spark, "history"), rd.two_model(spark, d)
    for _ in range(2):
        report.write_history(rd.yearly_scores(spark, d), hist, "batches")
        _stream_scores(spark, d, model, hist)
    return report.read_history(spark, hist).select("run_id", "grp", "n_rows", F.round("mse_pca", 9).alias("mse_pca"))


# ----------------------------------------------------------------- autoencoder
def _ae_model(spark, d):
    li = fx.lineitem_features(spark, d)
    ref, _ = fx.split_ref_current(li)
    return det.fit(ref, fx.LINEITEM_FEATURES, row_key=fx.ROW_KEY, build_ae=True), li


def q_m11(spark, d):
    """Loss of the weights that each epoch began with, on the training rows and on those held out; the last row is of the
    final weights."""
    m, _ = _ae_model(spark, d)
    return spark.createDataFrame(m.ae["history"], "epoch int, train_loss double, held_out_loss double")


def q_m17(spark, d):
    """The scenario matrix with both errors, in one pass over the reference."""
    m, li = _ae_model(spark, d)
    return det.score_scenarios(m, li.filter("is_ref"), fx.ROW_KEY, seed=SEED)


def q_m11_layers(spark, d):
    m, _ = _ae_model(spark, d)
    sizes = m.ae["sizes"]
    return spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(zip(sizes[:-1], sizes[1:]))],
                                 "layer int, n_in int, n_out int")


def q_m12(spark, d):
    m, _ = _ae_model(spark, d)
    rows = [(r, float(p), float(v)) for r, c in enumerate(m.ae["curves"]) for p, v in zip(c.pct, c.mse)]
    return spark.createDataFrame(rows, "rep int, perm_pct double, mse double")


def q_m13(spark, d):
    m, li = _ae_model(spark, d)
    return det.score(m, li, "is_ref").select("grp", "de_ae", "de_pca", "dp")


QUERIES = {
    "M18": q_m18, "M19": q_m19, "M20": q_m20, "M21": q_m21, "S14": q_s14,
    "M18_all": q_m18_all, "S14_all": q_s14_all,
    "M1": q_m1, "M2": q_m2, "M3": q_m3_two, "M4": q_m4_two, "M3_full": q_m3, "M4_full": q_m4,
    "S6": q_s7, "S8": q_s8, "WEEKLY_flow": q_weekly_flow,
    "S2_corrupt": q_s2_corrupt, "D6_quality": q_d6,
    "S1": q_s1, "S2": q_s2, "S3": q_s3, "S4": q_s4, "S5": q_s5, "S6_S8": q_s6_s8, "S7": q_s7, "S9": q_s9,
    "S10": q_s10, "S12": q_s12, "S13": q_s13, "O1": q_o1, "O2": q_o2, "O3": q_o3,
    "X1": q_x1, "X2": q_x2, "X2_full": q_x2_full, "U1": q_u1, "M11": q_m11, "M11_layers": q_m11_layers, "M17": q_m17, "M12": q_m12, "M13": q_m13,
}

ORACLE = {
    "M18": """WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a,
  regr_r2(l_extendedprice, l_quantity) AS r2 FROM lineitem)
SELECT ROUND(b, 4) AS slope, ROUND(a, 4) AS intercept,
  ROUND(SQRT((SELECT AVG(POW(l_extendedprice - (f.b * l_quantity + f.a), 2)) FROM lineitem)), 4) AS rmse,
  ROUND(r2, 6) AS r2 FROM f""",
    "S14": """SELECT ROUND(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
  ROUND(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem""",
}


def _normal_equations(features: list[str], label: str) -> str:
    """CTEs of the normal equations of centred columns, solved by Gauss-Jordan elimination;
    ``fit``: b0, b1, ... and intercept, rmse, r2."""
    n, x = range(len(features)), [*features, label]
    cells = [(i, j) for i in n for j in range(len(x))]
    steps = ["m AS (SELECT " + ", ".join([f"covar_pop({x[i]}, {x[j]}) AS a{i}_{j}" for i, j in cells]
             + [f"avg({c}) AS mean{i}" for i, c in enumerate(x)] + [f"var_pop({label}) AS var"]) + " FROM lineitem)", "g0 AS (FROM m)"]
    for k in n:
        steps.append(f"g{k + 1} AS (SELECT " + ", ".join(
            f"a{i}_{j} - a{i}_{k} * a{k}_{j} / a{k}_{k} AS a{i}_{j}" if i != k else f"a{i}_{j}" for i, j in cells) + f" FROM g{k})")
    y = len(features)
    steps.append("b AS (SELECT " + ", ".join(f"a{i}_{y} / a{i}_{i} AS b{i}" for i in n) + f" FROM g{y})")
    held = " + ".join(f"b{i} * a{i}_{y}" for i in n)
    steps.append(f"fit AS (SELECT b.*, mean{y} - ({' + '.join(f'b{i} * mean{i}' for i in n)}) AS intercept, "
                 f"sqrt(var - ({held})) AS rmse, ({held}) / var AS r2 FROM b, m)")
    return "WITH " + ",\n".join(steps) + "\n"


_ALL = ["l_linenumber", "l_quantity", "l_discount", "l_tax"]
for _id, _more in (("M18_all", ", ROUND(rmse, 4) AS rmse, ROUND(r2, 6) AS r2"), ("S14_all", "")):
    ORACLE[_id] = _normal_equations(_ALL, "l_extendedprice") + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, ROUND(b{i}, 4) AS coefficient, ROUND(intercept, 4) AS intercept{_more} FROM fit"
        for i, c in enumerate(_ALL))


def _more_oracles() -> dict:
    from windrift.registry_prep import BASE, _P6_SQL, _FULL_ROWS, _pca_stems
    out = {}
    cols = [f"{c}_8h" for c in _pca_stems()]
    out["M2"] = f"WITH w AS ({_P6_SQL}) " + " UNION ALL ".join(
        f"SELECT {j} AS j, '{c}' AS feature, ROUND(VAR_SAMP({c}), 1) AS variance, COALESCE(VAR_SAMP({c}) > 0, false) AS kept FROM w"
        for j, c in enumerate(cols))
    allf = [a for a, _, _ in _FULL_ROWS]
    out["M1"] = (f"WITH w AS ({_P6_SQL}) SELECT window_start, CELL, N_CELL, "
                 + ", ".join(f"{c} AS f{i}" for i, c in enumerate(allf)) + " FROM w")
    out["S1"] = (f"{BASE} SELECT strftime(date_trunc('second', DATETIME), '%Y-%m-%d %H:%M:%S') AS DATETIME, CELL, "
                 f"Traffic_Volume_Gbyte FROM kpi")
    time = f"CASE WHEN event_id % {BAD_TIME} <> 0 THEN date_trunc('second', ts) END"
    value = f"CASE WHEN event_id % {BAD_VALUE} <> 0 THEN value END"
    kpi = {"DATETIME": time, "CELL": "CAST(user_id AS VARCHAR)", "Traffic_Volume_Gbyte": value, "NUM_OF_RRC_Att": "CAST(event_id AS INTEGER)",
           "ERAB_Drop_PC": "CASE WHEN event_type = 'error' THEN CAST(100 AS DOUBLE) WHEN event_type <> 'view' THEN CAST(0 AS DOUBLE) END",
           "Nof_Avg_SimRRC_ConnUsr": "CAST(json_extract_string(props, '$.k') AS DOUBLE)"}
    out["S2"] = "SELECT " + ", ".join(f'{kpi.get(f.name, "NULL")} AS "{f.name}"' for f in kpi_schema().fields) + " FROM events"
    bad = f"event_id % {BAD_TIME} = 0 OR event_id % {BAD_VALUE} = 0"
    out["S2_corrupt"] = (f"SELECT CAST(user_id AS VARCHAR) AS CELL, CAST(event_id AS INTEGER) AS event_id, event_id % {BAD_TIME} = 0 AS bad_time, "
                         f"event_id % {BAD_VALUE} = 0 AS bad_value, 145 AS n_fields, CASE WHEN event_id % {BAD_TIME} = 0 THEN 'no time' "
                         f"ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS first_field FROM events WHERE {bad}")
    out["D6_quality"] = (f"SELECT COUNT(*) AS n_rows, COUNT(*) FILTER (WHERE event_id % {BAD_TIME} = 0) AS null_time, "
                         f"COUNT(*) FILTER (WHERE user_id IS NULL) AS null_cell, COUNT(*) FILTER (WHERE {bad}) AS corrupt FROM events")
    out["S3"] = f'{BASE} SELECT CAST(CELL AS VARCHAR) AS CELL, CAST(N_CELL AS VARCHAR) AS N_CELL, "Overlap_Alan%" FROM overlap'
    inferred = [("DATETIME", "timestamp", "DATETIME"), ("SectorID", "int", "CELL"), ("Traffic Volume Gbyte", "double", "Traffic_Volume_Gbyte"),
                ("ERAB_Drop_PC", "double", "ERAB_Drop_PC"), ("Nof_Avg_SimRRC_ConnUsr", "double", "Nof_Avg_SimRRC_ConnUsr")]
    out["S4"] = f"{BASE} " + " UNION ALL ".join(f"SELECT {j} AS j, '{n}' AS name, '{t}' AS type, COUNT({c}) AS n_values FROM kpi"
                                                for j, (n, t, c) in enumerate(inferred))
    out["X2"] = rd.two_sql("CAST(batch AS VARCHAR)", "TRUE") + " SELECT 'stream-0' AS run_id, grp, n_rows, ROUND(mse, 9) AS mse_pca FROM s"
    yearly = rd.two_sql("CAST(batch AS VARCHAR)", rd.LATER, rd.FIRST)
    out["U1"] = (f"SELECT * FROM ({out['X2']}) UNION ALL SELECT * FROM ({yearly} SELECT 'batches' AS run_id, grp, n_rows, "
                 "ROUND(mse, 9) AS mse_pca FROM s)")
    x, y = TWO_WINDOWED
    pca = (f"WITH w AS ({_P6_SQL}), c AS (SELECT VAR_SAMP({x}) AS a, COVAR_SAMP({x}, {y}) AS b, VAR_SAMP({y}) AS d FROM w), "
           "e AS (SELECT *, (a + d) / 2 + SQRT(POW((a - d) / 2, 2) + b * b) AS l FROM c), "
           "v AS (SELECT *, a + d - l AS m, (l - d) / SQRT(POW(l - d, 2) + b * b) AS p, b / SQRT(POW(l - d, 2) + b * b) AS q FROM e), "
           "u AS (SELECT l, m, CASE WHEN GREATEST(p, q) >= -LEAST(p, q) THEN 1 ELSE -1 END AS s1, "
           "CASE WHEN GREATEST(-q, p) >= -LEAST(-q, p) THEN 1 ELSE -1 END AS s2, p, q FROM v)")
    out["M4"] = pca + " SELECT 1 AS component, ROUND(l / (l + m), 6) AS ratio FROM u UNION ALL SELECT 2, ROUND(m / (l + m), 6) FROM u"
    out["M3"] = pca + (f" SELECT window_start, CELL, N_CELL, ROUND(s1 * (p * {x} + q * {y}), 4) + 0.0 AS f0, "
                       f"ROUND(s2 * (p * {y} - q * {x}), 4) + 0.0 AS f1 FROM w, u")
    out["S8"] = out["M3"]
    means = ("(SELECT ROUND(COALESCE(AVG(avg_traffic_volume_gbyte_8h), 0), 6) FROM w)", "(SELECT ROUND(COALESCE(AVG(avg_erab_drop_rate_8h), 0), 6) FROM w)")
    both = ("windowed_features", "ml_ready")
    gauges = [(j, m, v) for j in (*both, "failing_job") for m, v in (("job_duration_seconds", "1"), ("job_success", str(int(j in both))))]
    gauges += [("ml_ready", m, v) for m, v in (("feature_count", "18"), ("pca_features_count", "2"), ("avg_traffic_8h", means[0]),
                                               ("avg_erab_drop_rate_8h", means[1]))]
    out["S12"] = f"WITH w AS ({_P6_SQL}) " + " UNION ALL ".join(
        f"SELECT '{j}' AS job, '{m}' AS metric, CAST({v} AS DOUBLE) AS value" for j, m, v in gauges)
    not_made = [c for c in feat.PCA_FEATURES if c not in cols]
    first, second = both
    kept = [(first, "param", k, v) for k, v in (("overlap_threshold_pct", "40.0"), ("window_width", "8 hours"), ("fill", "zero"),
            ("missing_sources", "[]"), ("success", "yes"), ("total_metrics_count", "29"))]
    kept += [(second, "param", "missing_features", str(not_made)), (second, "param", "pca_explained_variance", "2")]
    kept += [(first, "artifact", "windowed_features", "windowed"), (first, "artifact", "feature_report", "windowed_report"),
             (second, "artifact", "ml_ready", "ml_ready")]
    numbers = [(first, "features_present", "25"), (first, "features_missing", "0"), (second, "drift_avg_traffic", means[0]),
               (second, "drift_avg_drop_rate", means[1]), *[(j, "job_duration_seconds", "1") for j in (*both, "failing_job")]]
    out["S13"] = f"WITH w AS ({_P6_SQL}) " + " UNION ALL ".join(
        ["SELECT '{}' AS job, '{}' AS kind, '{}' AS key, '{}' AS text, CAST(NULL AS DOUBLE) AS number".format(*(x.replace("'", "''") for x in r))
         for r in kept] + [f"SELECT '{j}', 'metric', '{k}', NULL, CAST({v} AS DOUBLE)" for j, k, v in numbers])
    wrong = "ValueError: no valid feature found in the input"
    out["O1"] = (f"SELECT * FROM (VALUES ('{first}', true, NULL), ('{second}', true, NULL), ('failing_job', false, '{wrong}')) "
                 "t(job, success, error)")
    out["O2"] = " UNION ALL ".join(f"SELECT '{j}' AS job, true AS has_duration, true AS is_logged, true AS fits" for j in (*both, "failing_job"))
    out["O3"] = (f"SELECT * FROM (VALUES ('{first}', NULL, true), ('{second}', '{first}', true), ('failing_job', '{first}', false)) "
                 "t(job, parent_job, success)")
    piv = ", ".join(f"CAST(SUM(CASE WHEN CELL % 20 = {i} THEN CAST(Traffic_Volume_Gbyte AS DECIMAL(18,2)) END) AS DOUBLE) AS c{i}"
                    for i in range(fx.N_SERIES))
    out["S5"] = f"{BASE} SELECT CAST(DATETIME AS DATE) AS date, {piv} FROM kpi GROUP BY 1"
    out["S7"] = _P6_SQL
    from windrift.registry_prep import _BASIC_ROWS, _windowed_sql
    out["X1"] = (f"WITH w AS ({_windowed_sql(_BASIC_ROWS, fill=False)}) SELECT * FROM w "
                 f"WHERE window_end <= (SELECT MAX(ts) FROM events) - INTERVAL '8 hours'")
    out["S6"] = _P6_SQL
    out["S9"] = (f'{BASE} SELECT N_CELL, ROUND(AVG("Overlap_Alan%"), 6) AS avg_overlap_pct FROM overlap GROUP BY N_CELL '
                 f'ORDER BY avg_overlap_pct DESC, N_CELL ASC LIMIT 10')
    out["S10"] = "SELECT n_nationkey AS id, n_name AS name, n_nationkey * 1.5 AS value FROM nation"
    return out


ORACLE.update(_more_oracles())
