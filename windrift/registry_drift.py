"""Registered queries for statistics, injection, ordering and the drift
detector (B3 inputs), with DuckDB oracles where the result is SQL-expressible."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from windrift.functions import bands
from windrift.functions.scalar import clip, gaussian, signed_cbrt, standardize
from windrift.operators import inject, ordering, reshape, stats
from windrift.plans import detector as det
from windrift.plans import report
from windrift.session import scratch_path
from windrift.sources import fixtures as fx

FEATS = fx.LINEITEM_FEATURES
SEED = 42
N_DIM = 64  # of the embeddings

# ----------------------------------------------------------------- oracle snippets
# SQL of the derived lineitem features, in FEATS order.
FEAT_SQL = {
    "l_quantity": "l_quantity",
    "l_extendedprice": "l_extendedprice",
    "disc_price": "l_extendedprice * (1 - l_discount)",
    "charge": "l_extendedprice * (1 - l_discount) * (1 + l_tax)",
    "l_discount": "l_discount",
    "tax_amt": "l_extendedprice * l_tax",
    "disc_amt": "l_extendedprice * l_discount",
}
LI_SQL = ("li AS (SELECT l_orderkey, l_linenumber, (l_shipdate < TIMESTAMP '1998-06-01') AS is_ref, "
          "year(l_shipdate) AS batch, " + ", ".join(f"{e} AS {n}" for n, e in FEAT_SQL.items()) + " FROM lineitem)")
REF_STATS_SQL = ("st AS (SELECT " + ", ".join(f"AVG({c}) AS m_{c}, STDDEV_POP({c}) AS s_{c}" for c in FEATS)
                 + " FROM li WHERE is_ref)")


def _z_sql(c: str) -> str:
    return f"(({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END)"


def _stat_sql(fn: str, rounded: bool, alias_ref="reference", alias_cur="current", pct=True) -> str:
    parts = []
    for j, c in enumerate(FEATS):
        r = f"(SELECT {fn}({c}) FROM li WHERE is_ref)"
        u = f"(SELECT {fn}({c}) FROM li WHERE NOT is_ref)"
        p = f"({u} - {r}) / NULLIF({r}, 0) * 100"
        if rounded:
            r, u, p = f"ROUND({r}, 2)", f"ROUND({u}, 2)", f"ROUND({p}, 2)"
        cols = f"{j} AS j, '{c}' AS feature, {r} AS {alias_ref}, {u} AS {alias_cur}"
        if pct:
            cols += f", {p} AS change_pct"
        parts.append(f"SELECT {cols}")
    return f"WITH {LI_SQL} " + " UNION ALL ".join(parts)


# ----------------------------------------------------------------- Spark side
def _li(spark, d):
    return fx.lineitem_features(spark, d)


def _split(spark, d):
    return fx.split_ref_current(_li(spark, d))


def q_a10(spark, d):
    return stats.compare_stat(_li(spark, d), FEATS, "mean")


def q_a11(spark, d):
    return stats.compare_stat(_li(spark, d), FEATS, "std")


def q_a12(spark, d):
    r, _ = _split(spark, d)
    t = stats.scaler_table(r, FEATS)
    return t.select("j", "feature", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def q_a13(spark, d):
    r, _ = _split(spark, d)
    return stats.dataset_shape(r, FEATS)


def q_j3(spark, d):
    t = stats.align_stats(_li(spark, d), FEATS)
    return t.select("j", "feature", *[F.round(x, 6).alias(x) for x in ("ref_mean", "cur_mean", "ref_std", "cur_std")])


def q_f5(spark, d):
    t = stats.compare_stat(_li(spark, d), FEATS, "mean", rounded=False)
    return t.select("j", "feature", (F.round("change_pct", 6) + F.lit(0.0)).alias("change_pct"))


def q_f6(spark, d):
    return q_a10(spark, d)


def q_f12(spark, d):
    t = stats.mean_flags(_li(spark, d), FEATS)
    return t.select("j", "feature", (F.round("change_pct", 6) + F.lit(0.0)).alias("change_pct"), "flagged")


def q_f2(spark, d):
    li = _li(spark, d)
    return li.select("l_orderkey", "l_linenumber", *[F.round(signed_cbrt(c), 9).alias(c) for c in FEATS])


def q_f3(spark, d):
    li = _li(spark, d)
    return li.select("l_orderkey", "l_linenumber", clip(F.col("charge") / 1000.0 - 10.0).alias("clipped"))


def q_f4(spark, d):
    li = _li(spark, d)
    mean, std, _ = det.scaler_stats(li.filter("is_ref"), FEATS)
    return li.select("l_orderkey", "l_linenumber",
                     *[(F.round(standardize(c, float(mean[j]), float(std[j])), 6) + F.lit(0.0)).alias(c)
                       for j, c in enumerate(FEATS)])


def _band_input(spark, d):
    """Scores at every cut, just below it, and missing, with their row counts."""
    score = F.col("l_discount") * 1000
    li = fx.table(spark, d, "lineitem").select(F.explode(F.array(score, score - 0.01, F.lit(None).cast("double"))).alias("score"))
    return li.groupBy("score").agg(F.count(F.lit(1)).alias("n_rows"))


def q_f7_f11(spark, d):
    b = _band_input(spark, d)
    return b.select("score", "n_rows",
                    bands.band("score", "dp").alias("band_dp"), bands.band("score", "de").alias("band_de"),
                    bands.band("score", "printer").alias("advice_printer"),
                    bands.band("score", "guide").alias("advice_guide"),
                    bands.band("score", "actions").alias("actions"), bands.band("score", "verdict").alias("verdict"))


def _band_query(policy: str, alias: str):
    def run(spark, d):
        b = _band_input(spark, d)
        return b.select("score", "n_rows", bands.band("score", policy).alias(alias))
    run.__name__ = f"q_band_{policy}"
    return run


def q_f7(spark, d):
    """band text chosen by metric type, for both metric kinds."""
    b = _band_input(spark, d)
    long = b.select("score", "n_rows", F.explode(F.array(F.lit("dP"), F.lit("dE_PCA"))).alias("metric"))
    return long.select("metric", "score", "n_rows", bands.metric_band("metric", "score").alias("band"))


def q_f14(spark, d):
    li = _li(spark, d)
    return li.select(*fx.ROW_KEY, gaussian(SEED, *fx.ROW_KEY).alias("noise"))


def q_i1(spark, d):
    chosen = inject.choose_columns(FEATS, 0.4, SEED)
    li = _li(spark, d).filter("is_ref")
    out = inject.inject_scale(li, chosen)
    return out.select("l_orderkey", "l_linenumber", *[F.round(c, 9).alias(c) for c in FEATS])


def q_i2(spark, d):
    chosen = inject.choose_columns(FEATS, 0.3, SEED)
    li = _li(spark, d).filter("is_ref")
    out = inject.inject_shift(li, chosen)
    return out.select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(c) for c in FEATS])


def q_i3(spark, d):
    chosen = inject.choose_columns(FEATS, 0.5, SEED)
    li = _li(spark, d).filter("is_ref")
    return inject.inject_noise(li, chosen, fx.ROW_KEY, SEED).select(*fx.ROW_KEY, *FEATS)


def q_i4(spark, d):
    li = _li(spark, d).filter("is_ref")
    return inject.delete_rows(li, 0.2, fx.ROW_KEY, SEED).select(*fx.ROW_KEY, *FEATS)


def q_i5(spark, d):
    chosen = inject.choose_columns(FEATS, 0.4, SEED)
    return _li(spark, d).select(*chosen)


def _emb_nulls(spark, d):
    emb = fx.table(spark, d, "embeddings")
    cols = [F.when(F.col("vec_id") % 7 == j, F.lit(None).cast("double"))
            .otherwise(F.col("embedding")[j].cast("double")).alias(f"e{j}") for j in range(N_DIM)]
    return emb.select("vec_id", *cols)


def q_p14(spark, d):
    return reshape.to_long(_emb_nulls(spark, d), ["vec_id"], [f"e{j}" for j in range(N_DIM)])


def q_p14_back(spark, d):
    e = _emb_nulls(spark, d)
    names = [f"e{j}" for j in range(N_DIM)]
    return reshape.to_wide(reshape.to_long(e, ["vec_id"], names), ["vec_id"], names)


def q_p15(spark, d):
    return reshape.row_mean_impute(_emb_nulls(spark, d), [f"e{j}" for j in range(N_DIM)])


def q_p16(spark, d):
    o = fx.table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return ordering.ordered_split(o, ["o_orderdate", "o_orderkey"], 0.5).select("o_orderkey", "is_ref")


def q_p17(spark, d):
    return reshape.hash_split(fx.table(spark, d, "orders"), ["o_orderkey"], 0.8, SEED) \
        .groupBy("is_train").agg(F.count(F.lit(1)).alias("n_rows"))


def q_p18(spark, d):
    train = reshape.hash_split(fx.table(spark, d, "orders"), ["o_orderkey"], 0.8, SEED).filter("is_train")
    return reshape.keep_first_share(train, 0.7, ["o_orderkey"], SEED).select("o_orderkey")


def q_p19(spark, d):
    li = _li(spark, d)
    first5 = reshape.first_columns(li, FEATS, 5).columns
    return stats.compare_stat(li, first5, "mean", rounded=False) \
        .select("j", "feature", F.round("reference", 6).alias("reference"), F.round("current", 6).alias("current"))


# ----------------------------------------------------------------- drift (scores)
def _fit(spark, d, calibration="permute"):
    r, _ = _split(spark, d)
    return det.fit(r, FEATS, 0.90, calibration=calibration, row_key=fx.ROW_KEY)


def q_g1(spark, d):
    g = det.gram_table(_li(spark, d), FEATS, "is_ref", ref_group="true")
    return g.select("grp", "i", "j", (F.round("v", 6) + F.lit(0.0)).alias("v"))


EMB = fx.embedding_names()


def q_g1_wide(spark, d):
    g = det.gram_table(fx.embedding_features(spark, d), EMB, "is_ref", ref_group="true")
    return g.select("grp", "i", "j", (F.round("v", 6) + F.lit(0.0)).alias("v"))


def q_m5(spark, d):
    return report.model_table(spark, _fit(spark, d))


def q_m6(spark, d):
    return report.eigen_table(spark, _fit(spark, d))


def q_m7(spark, d):
    from windrift.plans.permute import permute_cells
    r, _ = _split(spark, d)
    mean, std, _ = det.scaler_stats(r, FEATS)
    scaled = det.scale_columns(r, FEATS, mean, std, keep=fx.ROW_KEY)
    return permute_cells(scaled, FEATS, fx.ROW_KEY, 0.31, SEED)


def q_m8(spark, d):
    return report.calibration_rows(spark, _fit(spark, d))


def q_m8_permute(spark, d):
    return q_m8(spark, d)


def q_m8_expected(spark, d):
    """The closed form of the curves' expectation, on request."""
    return report.calibration_rows(spark, _fit(spark, d, "expected"))


def _scores(spark, d, group="is_ref"):
    m = _fit(spark, d)
    return m, det.score(m, _li(spark, d), group)


def q_m9(spark, d):
    _, s = _scores(spark, d)
    return s.select("grp", "dp", "k_ref", "k_cur", "min_eigen_gap")


def q_m10(spark, d):
    _, s = _scores(spark, d)
    return s.select("grp", "de_pca", "mse_pca", "degenerate")


def q_g2(spark, d):
    _, s = _scores(spark, d)
    return s.select("grp", "n_rows", "mse_pca")


def q_a14(spark, d):
    return q_g2(spark, d)


def q_a15(spark, d):
    m, s = _scores(spark, d)
    return report.curve_values(spark, m, s)


def q_f13(spark, d):
    r, c = _split(spark, d)
    m = det.fit(r, FEATS)
    return report.cosine_table(spark, m, c)


def q_m14(spark, d):
    _, s = _scores(spark, d)
    return s


def q_m15(spark, d):
    _, s = _scores(spark, d)
    return report.result_report(s)


def q_m16(spark, d):
    """Batch monitoring: the first year is the reference, every later year a
    batch, all batches scored by one grouped pass."""
    li = _li(spark, d)
    first = li.agg(F.min("batch").alias("y")).first()["y"]
    m = det.fit(li.filter(F.col("batch") == F.lit(first)), FEATS)
    return det.score(m, li.filter(F.col("batch") > F.lit(first)), "batch")


def q_m17_pca(spark, d):
    """The scenario matrix of a model without an autoencoder."""
    r, _ = _split(spark, d)
    return det.score_scenarios(det.fit(r, FEATS), r, fx.ROW_KEY, seed=SEED)


def q_d26(spark, d):
    li = fx.lineitem_raw(spark, d)
    r, _ = fx.split_ref_current(li)
    m = det.fit(r, fx.LINEITEM_RAW_FEATURES)
    return det.score(m, li, "is_ref")


def q_m14_wide(spark, d):
    e = fx.embedding_features(spark, d)
    r, _ = fx.split_ref_current(e)
    m = det.fit(r, EMB)
    return det.score(m, e, "is_ref")


def q_s15(spark, d):
    m = _fit(spark, d)
    path = scratch_path(spark, f"drift-model-{uuid.uuid4().hex[:8]}")
    m.save(spark, path)
    back = det.DriftModel.load(spark, path)
    return det.score(back, _li(spark, d), "is_ref")


# ----------------------------------------------------------------- two features: everything in closed form
#: Two features that go together: k is 1 of 2, and eigenvalues, loadings and errors have closed forms.
TWO = ["l_extendedprice", "charge"]
#: Cubics of the error that the given curves sample (c0, c1, c2, c3); a spline through them is the cubic.
CUBICS = [(5.0, 1500.0, 20_000.0, -100_000.0), (-10.0, 3000.0, 0.0, 0.0)]
#: Three orthonormal loadings over the seven features.
LOADINGS = [[0.5, 0.5, 0.5, 0.5, 0.0, 0.0, 0.0], [0.5, -0.5, 0.0, 0.0, 0.5, -0.5, 0.0], [0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0]]


def _cubic_curves():
    x = [0.005 * i for i in range(10)]
    return [det.Curve(x, [c0 + v * (c1 + v * (c2 + v * c3)) for v in x]) for c0, c1, c2, c3 in CUBICS]


def two_model(spark, d, reference=None):
    """The detector of the two features, with the given curves."""
    m = det.fit(_li(spark, d).filter("is_ref") if reference is None else reference, TWO, calibration="expected")
    return det.with_loadings(m, m.pca.components, _cubic_curves())


def _two_scores(spark, d):
    return det.score(two_model(spark, d), _li(spark, d), "is_ref")


def _digits(df, **digits):
    return df.select(*[(F.round(c, digits[c]) + F.lit(0.0)).alias(c) if c in digits else F.col(c) for c in df.columns])


def q_m5_two(spark, d):
    t = report.model_table(spark, two_model(spark, d)).withColumn("loading", F.col("loadings")[0]).drop("loadings")
    return _digits(t, mean=6, std=6, loading=9)


def q_m6_two(spark, d):
    return _digits(report.eigen_table(spark, two_model(spark, d)), eigenvalue=9, ratio=9, cumulative=9)


def q_m8_two(spark, d):
    """Ten permuted curves: every level's mean error lies near its expectation, and every curve rises."""
    ref = _li(spark, d).filter("is_ref")
    m = det.fit(ref, TWO, row_key=fx.ROW_KEY)
    want = det.fit(ref, TWO, calibration="expected").curves[0]
    near = spark.createDataFrame(list(zip(want.pct, want.mse, strict=True)), "perm_pct double, want double")
    t = report.calibration_rows(spark, m).groupBy("perm_pct").agg(F.count(F.lit(1)).alias("n_curves"), F.avg("mse").alias("mse"),
                                                                  F.max("guarded").alias("guarded"))
    return t.join(near, "perm_pct").select(F.round("perm_pct", 6).alias("perm_pct"), "n_curves", "guarded",
                                           (F.abs(F.col("mse") / F.col("want") - 1) < 0.05).alias("near"))


def q_m8_expected_two(spark, d):
    m = det.fit(_li(spark, d).filter("is_ref"), TWO, calibration="expected")
    return _digits(report.calibration_rows(spark, m), perm_pct=6, mse=9)


def q_m9_two(spark, d):
    return _digits(_two_scores(spark, d).select("grp", "dp", "k_ref", "k_cur", "min_eigen_gap"), dp=6, min_eigen_gap=9)


def q_m10_two(spark, d):
    return _digits(_two_scores(spark, d).select("grp", "de_pca", "mse_pca", "degenerate"), de_pca=6, mse_pca=9)


def q_m14_two(spark, d):
    return _digits(_two_scores(spark, d).drop("min_eigen_gap", "curve_min", "curve_max"), dp=6, de_pca=6, mse_pca=9)


def q_m15_two(spark, d):
    return _digits(report.result_report(_two_scores(spark, d)), value=6)


def yearly_scores(spark, d):
    li = _li(spark, d)
    first = li.agg(F.min("batch").alias("y")).first()["y"]
    m = two_model(spark, d, li.filter(F.col("batch") == F.lit(first)))
    return det.score(m, li.filter(F.col("batch") > F.lit(first)), "batch")


def q_m16_two(spark, d):
    return _digits(yearly_scores(spark, d).select("grp", "n_rows", "dp", "mse_pca", "de_pca"), dp=6, mse_pca=9, de_pca=6)


def q_w2_two(spark, d):
    return _digits(report.trend(yearly_scores(spark, d), "grp", "mse_pca", partitions=4), mse_pca=9, prev_mse_pca=9, delta_mse_pca=9)


def q_w2_series(spark, d):
    """Change of the price of each customer's orders from one to the next."""
    o = fx.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return _digits(report.trend(o, "o_orderkey", "o_totalprice", ["o_custkey"]), delta_o_totalprice=2)


def q_s15_two(spark, d):
    path = scratch_path(spark, f"drift-model-{uuid.uuid4().hex[:8]}")
    two_model(spark, d).save(spark, path)
    s = det.score(det.DriftModel.load(spark, path), _li(spark, d), "is_ref")
    return _digits(s.drop("min_eigen_gap", "curve_min", "curve_max"), dp=6, de_pca=6, mse_pca=9)


def q_f13_two(spark, d):
    return _digits(report.cosine_table(spark, two_model(spark, d), _li(spark, d).filter("NOT is_ref")), lambda_ref=9, abs_cos=9)


def q_g2_given(spark, d):
    """Error of given loadings over all seven features."""
    m = det.fit(_li(spark, d).filter("is_ref"), FEATS, calibration="expected")
    s = det.score(det.with_loadings(m, LOADINGS), _li(spark, d), "is_ref")
    return _digits(s.select("grp", "n_rows", "mse_pca"), mse_pca=9)


def q_a15_two(spark, d):
    m = two_model(spark, d)
    return _digits(report.curve_values(spark, m, det.score(m, _li(spark, d), "is_ref")), de_pca=6)


def q_m17_fixed(spark, d):
    """The scenarios that draw nothing, on the two features."""
    r = _li(spark, d).filter("is_ref")
    s = det.score_scenarios(two_model(spark, d), r, fx.ROW_KEY, [x for x in inject.SCENARIOS if x[1] in ("scale", "shift")], SEED)
    return _digits(s.select("grp", "n_rows", "dp", "mse_pca"), dp=6, mse_pca=9)


def q_m7_digest(spark, d):
    """The multiset of cell values after the permutation."""
    cells = q_m7(spark, d).select(F.explode(F.array(*FEATS)).alias("v"))
    return cells.agg(F.count("v").alias("n"), (F.round(F.sum("v"), 4) + F.lit(0.0)).alias("s1"), F.round(F.sum(F.col("v") * F.col("v")), 3).alias("s2"),
                     F.round(F.min("v"), 9).alias("least"), F.round(F.max("v"), 9).alias("most"))


def _drawn(spark, d):
    li = _li(spark, d).filter("is_ref")
    return li, li.select(*fx.ROW_KEY)


def q_i3_bounds(spark, d):
    """What the noise adds: a mean near 0 and a spread near the column's own in the chosen columns, nothing in the others."""
    li, _ = _drawn(spark, d)
    chosen = inject.choose_columns(FEATS, 0.5, SEED)
    noisy = inject.inject_noise(li, chosen, fx.ROW_KEY, SEED).select(*fx.ROW_KEY, *[F.col(c).alias(f"_{c}") for c in FEATS])
    both = li.join(noisy, fx.ROW_KEY)
    made = both.agg(F.count(F.lit(1)).alias("n"), *[x for c in FEATS for x in (
        F.avg(F.col(f"_{c}") - F.col(c)).alias(f"m_{c}"), F.stddev_samp(F.col(f"_{c}") - F.col(c)).alias(f"s_{c}"), F.stddev_samp(c).alias(f"o_{c}"))])
    rows = [F.struct(F.lit(c).alias("feature"), F.col("n").alias("n_rows"), (F.col(f"s_{c}") > 0).alias("changed"),
                     (F.abs(f"m_{c}") <= 5 * F.col(f"s_{c}") / F.sqrt("n")).alias("centred"),
                     ((F.col(f"s_{c}") == 0) | (F.abs(F.col(f"s_{c}") / F.col(f"o_{c}") - 1) < 5 / F.sqrt("n"))).alias("spread")) for c in FEATS]
    return made.select(F.inline(F.array(*rows)))


def q_f14_bounds(spark, d):
    t = q_f14(spark, d).agg(F.count("noise").alias("n_rows"), F.avg("noise").alias("m"), F.stddev_samp("noise").alias("s"),
                            F.countDistinct("noise").alias("k"))
    return t.select("n_rows", (F.abs("m") < 5 / F.sqrt("n_rows")).alias("centred"), (F.abs(F.col("s") - 1) < 5 / F.sqrt("n_rows")).alias("spread"),
                    (F.col("k") == F.col("n_rows")).alias("all_differ"))


def q_i4_exact(spark, d):
    """Exactly so many rows stay, each once and each one of the reference."""
    _, keys = _drawn(spark, d)
    kept = q_i4(spark, d).select(*fx.ROW_KEY)
    stray = kept.join(keys, fx.ROW_KEY, "left_anti").agg(F.count(F.lit(1)).alias("n_stray"))
    return kept.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(*fx.ROW_KEY).alias("n_keys")).join(F.broadcast(stray))


def q_p17_exact(spark, d):
    t = reshape.hash_split(fx.table(spark, d, "orders"), ["o_orderkey"], 0.8, SEED).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if("is_train").alias("k"), F.count_if(F.col("is_train").isNull()).alias("n_without"))
    return t.select("n_rows", "n_without", (F.abs(F.col("k") / F.col("n_rows") - 0.8) < 5 * F.sqrt(0.16 / F.col("n_rows"))).alias("near_share"))


def q_p18_exact(spark, d):
    """Of the training rows exactly int(n * 0.7) stay, all of them training rows."""
    split = reshape.hash_split(fx.table(spark, d, "orders"), ["o_orderkey"], 0.8, SEED)
    kept = q_p18(spark, d).withColumn("kept", F.lit(True))
    t = split.join(kept, "o_orderkey", "left").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("is_train").alias("k"),
                                                   F.count("kept").alias("n"), F.count_if(F.col("kept") & ~F.col("is_train")).alias("n_stray"))
    return t.select("n_rows", (F.col("n") == F.floor(F.col("k") * 0.7)).alias("exact"), "n_stray")


QUERIES = {
    "A10": q_a10, "A11": q_a11, "A12": q_a12, "A13": q_a13, "J3": q_j3, "F2": q_f2, "F3": q_f3, "F4": q_f4,
    "F5": q_f5, "F6": q_f6, "F7_F11": q_f7_f11, "F7": q_f7, "F8": _band_query("printer", "advice"),
    "F9": _band_query("guide", "advice"), "F10": _band_query("actions", "actions"),
    "F11": _band_query("verdict", "verdict"), "F12": q_f12, "F14": q_f14_bounds, "F14_full": q_f14,
    "I1": q_i1, "I2": q_i2, "I3": q_i3_bounds, "I3_full": q_i3, "I4": q_i4_exact, "I4_full": q_i4, "I5": q_i5,
    "P14": q_p14, "P14_back": q_p14_back, "P15": q_p15, "P16": q_p16, "P17": q_p17_exact, "P17_full": q_p17, "P18": q_p18_exact,
    "P18_full": q_p18, "P19": q_p19,
    "G1": q_g1, "G1_wide": q_g1_wide, "G2": q_g2_given, "G2_full": q_g2, "A14": q_g2_given, "A14_full": q_a14, "A15": q_a15_two,
    "A15_full": q_a15, "F13": q_f13_two, "F13_full": q_f13,
    "M5": q_m5_two, "M6": q_m6_two, "M7": q_m7_digest, "M8": q_m8_two, "M9": q_m9_two, "M10": q_m10_two,
    "M5_full": q_m5, "M6_full": q_m6, "M7_full": q_m7, "M8_full": q_m8, "M9_full": q_m9, "M10_full": q_m10,
    "M8_permute": q_m8_permute, "M8_expected": q_m8_expected_two, "M8_expected_full": q_m8_expected,
    "M14": q_m14_two, "M14_full": q_m14, "M14_wide": q_m14_wide, "M14_degenerate": q_d26, "M15": q_m15_two, "M15_full": q_m15,
    "M16": q_m16_two, "M16_full": q_m16, "M17_pca": q_m17_pca, "M17_fixed": q_m17_fixed,
    "W2": q_w2_two, "W2_series": q_w2_series, "S15": q_s15_two, "S15_full": q_s15,
}

# ----------------------------------------------------------------- oracle SQL
ORACLE: dict[str, str] = {}
ORACLE["A10"] = _stat_sql("AVG", True)
ORACLE["A11"] = _stat_sql("STDDEV_SAMP", True)
ORACLE["F6"] = ORACLE["A10"]
ORACLE["A12"] = f"WITH {LI_SQL}, {REF_STATS_SQL} " + " UNION ALL ".join(
    f"SELECT {j} AS j, '{c}' AS feature, ROUND(m_{c}, 6) AS mean, ROUND(s_{c}, 6) AS std FROM st"
    for j, c in enumerate(FEATS))
ORACLE["A13"] = f"WITH {LI_SQL} SELECT COUNT(*) AS n_rows, {len(FEATS)} AS n_features FROM li WHERE is_ref"
ORACLE["J3"] = f"WITH {LI_SQL} " + " UNION ALL ".join(
    f"SELECT {j} AS j, '{c}' AS feature, "
    f"ROUND((SELECT AVG({c}) FROM li WHERE is_ref), 6) AS ref_mean, "
    f"ROUND((SELECT AVG({c}) FROM li WHERE NOT is_ref), 6) AS cur_mean, "
    f"ROUND((SELECT STDDEV_SAMP({c}) FROM li WHERE is_ref), 6) AS ref_std, "
    f"ROUND((SELECT STDDEV_SAMP({c}) FROM li WHERE NOT is_ref), 6) AS cur_std" for j, c in enumerate(FEATS))
_PCT = "((SELECT AVG({c}) FROM li WHERE NOT is_ref) - (SELECT AVG({c}) FROM li WHERE is_ref)) / NULLIF((SELECT AVG({c}) FROM li WHERE is_ref), 0) * 100"
ORACLE["F5"] = f"WITH {LI_SQL} " + " UNION ALL ".join(
    f"SELECT {j} AS j, '{c}' AS feature, ROUND({_PCT.format(c=c)}, 6) + 0.0 AS change_pct" for j, c in enumerate(FEATS))
ORACLE["F12"] = f"WITH {LI_SQL} " + " UNION ALL ".join(
    f"SELECT {j} AS j, '{c}' AS feature, ROUND({_PCT.format(c=c)}, 6) + 0.0 AS change_pct, "
    f"ABS({_PCT.format(c=c)}) > 10 AS flagged" for j, c in enumerate(FEATS))
ORACLE["F2"] = f"WITH {LI_SQL} SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"ROUND(SIGN({c}) * POW(ABS({c}), 1.0 / 3.0), 9) AS {c}" for c in FEATS) + " FROM li"
ORACLE["F3"] = (f"WITH {LI_SQL} SELECT l_orderkey, l_linenumber, "
                f"LEAST(GREATEST(charge / 1000.0 - 10.0, 0.0), 100.0) AS clipped FROM li")
ORACLE["F4"] = f"WITH {LI_SQL}, {REF_STATS_SQL} SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"ROUND({_z_sql(c)}, 6) + 0.0 AS {c}" for c in FEATS) + " FROM li, st"
# Written by hand, apart from bands.POLICIES, so that a wrong cut there shows.
_DP = """CASE WHEN score < 10 THEN 'Very Low Drift - Covariance structure highly similar'
  WHEN score < 30 THEN 'Low Drift - Minor changes in covariance structure'
  WHEN score < 50 THEN 'Moderate Drift - Noticeable changes detected'
  WHEN score < 70 THEN 'High Drift - Significant structural changes'
  WHEN score >= 70 THEN 'Very High Drift - Major version update recommended' END"""
_DE = """CASE WHEN score < 10 THEN 'Very Low Drift - Data highly similar'
  WHEN score < 30 THEN 'Low Drift - Minor changes in distribution'
  WHEN score < 50 THEN 'Moderate Drift - Data still recognizable'
  WHEN score < 70 THEN 'High Drift - Substantial differences'
  WHEN score >= 70 THEN 'Very High Drift - Data drastically different (like random noise)' END"""
_PRINTER = """CASE WHEN score < 30 THEN 'Minor version update (0.X.0)'
  WHEN score < 70 THEN 'Consider minor version update, review changes'
  WHEN score >= 70 THEN 'Major version update recommended (X.0.0)' END"""
_GUIDE = """CASE WHEN score < 30 THEN 'minor update' WHEN score < 50 THEN 'review: minor or major update'
  WHEN score >= 50 THEN 'major update' END"""
_ACTIONS = """CASE WHEN score < 10 THEN 'very low drift: no action needed'
  WHEN score < 30 THEN 'low to moderate drift: minor version update, monitor trends, document changes'
  WHEN score < 50 THEN 'moderate drift: review data quality, consider retraining, update documentation'
  WHEN score >= 50 THEN 'high drift: major version update, investigate causes, retrain models, update data jobs' END"""
_VERDICT = "CASE WHEN score < 30 THEN 'confirmed' WHEN score < 50 THEN 'medium' WHEN score >= 50 THEN 'high' END"
_B_IN = ("WITH b AS (SELECT score, COUNT(*) AS n_rows FROM (SELECT UNNEST([l_discount * 1000, l_discount * 1000 - 0.01, NULL]) "
         "AS score FROM lineitem) GROUP BY score) ")
ORACLE["F7_F11"] = _B_IN + (f"SELECT score, n_rows, {_DP} AS band_dp, {_DE} AS band_de, {_PRINTER} AS advice_printer, "
                            f"{_GUIDE} AS advice_guide, {_ACTIONS} AS actions, {_VERDICT} AS verdict FROM b")


def _inject_sql(kind: str, intensity: float, digits: int) -> str:
    chosen = inject.choose_columns(FEATS, intensity, SEED)
    exprs = []
    for c in FEATS:
        if c in chosen and kind == "scale":
            e = f"SIGN({c}) * POW(ABS({c}), 1.0 / 3.0)"
        elif c in chosen and kind == "shift":
            e = f"{c} + 2.0 * (SELECT STDDEV_SAMP({c}) FROM li WHERE is_ref)"
        else:
            e = c
        exprs.append(f"ROUND({e}, {digits}) AS {c}")
    return f"WITH {LI_SQL} SELECT l_orderkey, l_linenumber, {', '.join(exprs)} FROM li WHERE is_ref"


ORACLE["I1"] = _inject_sql("scale", 0.4, 9)
ORACLE["I2"] = _inject_sql("shift", 0.3, 6)
ORACLE["I5"] = f"WITH {LI_SQL} SELECT {', '.join(inject.choose_columns(FEATS, 0.4, SEED))} FROM li"

EMB_SQL = ("e64 AS (SELECT vec_id, " + ", ".join(
    f"CASE WHEN vec_id % 7 = {j} THEN NULL ELSE CAST(embedding[{j + 1}] AS DOUBLE) END AS e{j}" for j in range(N_DIM))
    + " FROM embeddings)")
ORACLE["P14"] = f"WITH {EMB_SQL} " + " UNION ALL ".join(
    f"SELECT vec_id, 'e{j}' AS feature, e{j} AS value FROM e64" for j in range(N_DIM))
ORACLE["P14_back"] = f"WITH {EMB_SQL} SELECT * FROM e64"
_present = " + ".join(f"(CASE WHEN e{j} IS NULL THEN 0 ELSE 1 END)" for j in range(N_DIM))
_total = "0.0 + " + " + ".join(f"COALESCE(e{j}, 0.0)" for j in range(N_DIM))
ORACLE["P15"] = (f"WITH {EMB_SQL}, rm AS (SELECT *, CASE WHEN {_present} > 0 THEN ({_total}) / ({_present}) END AS m "
                 f"FROM e64) SELECT vec_id, " + ", ".join(f"COALESCE(e{j}, m) AS e{j}" for j in range(N_DIM)) + " FROM rm")
ORACLE["P16"] = ("WITH o AS (SELECT o_orderkey, ROW_NUMBER() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS rn, "
                 "COUNT(*) OVER () AS n FROM orders) "
                 "SELECT o_orderkey, rn < CAST(FLOOR(n * 0.5) AS BIGINT) AS is_ref FROM o")
ORACLE["P19"] = f"WITH {LI_SQL} " + " UNION ALL ".join(
    f"SELECT {j} AS j, '{c}' AS feature, ROUND((SELECT AVG({c}) FROM li WHERE is_ref), 6) AS reference, "
    f"ROUND((SELECT AVG({c}) FROM li WHERE NOT is_ref), 6) AS current" for j, c in enumerate(FEATS[:5]))


def _g1_sql() -> str:
    zs = ", ".join(f"{_z_sql(c)} AS z{j + 1}" for j, c in enumerate(FEATS))
    names = ["1.0"] + [f"z{j + 1}" for j in range(len(FEATS))]
    sums, sels = [], []
    for i in range(len(names)):
        for j in range(i, len(names)):
            sums.append(f"SUM({names[i]} * {names[j]}) AS p{i}_{j}")
            sels.append(f"SELECT grp, {i} AS i, {j} AS j, ROUND(p{i}_{j}, 6) + 0.0 AS v FROM agg")
    return (f"WITH {LI_SQL}, {REF_STATS_SQL}, z AS (SELECT CAST(is_ref AS VARCHAR) AS grp, {zs} FROM li, st), "
            f"agg AS (SELECT grp, {', '.join(sums)} FROM z GROUP BY grp) " + " UNION ALL ".join(sels))


ORACLE["G1"] = _g1_sql()
ORACLE["G1_wide"] = """WITH e AS (SELECT vec_id, label < 5 AS is_ref, embedding FROM embeddings),
l AS (SELECT vec_id, is_ref, UNNEST(generate_series(1, 64)) AS i, UNNEST(embedding) AS v FROM e),
st AS (SELECT i, AVG(CAST(v AS DOUBLE)) AS m, STDDEV_POP(CAST(v AS DOUBLE)) AS s FROM l WHERE is_ref GROUP BY i),
z AS (SELECT l.vec_id, CAST(l.is_ref AS VARCHAR) AS grp, l.i,
             (CAST(l.v AS DOUBLE) - st.m) / CASE WHEN st.s = 0 THEN 1 ELSE st.s END AS z
      FROM l JOIN st ON l.i = st.i
      UNION ALL SELECT vec_id, CAST(is_ref AS VARCHAR) AS grp, 0 AS i, 1.0 AS z FROM e)
SELECT a.grp AS grp, CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, ROUND(SUM(a.z * b.z), 6) + 0.0 AS v
FROM z a JOIN z b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY a.grp, a.i, b.i"""

ORACLE["F7"] = _B_IN + (", m AS (SELECT * FROM b, (VALUES ('dP'), ('dE_PCA')) t(metric)) "
                        f"SELECT metric, score, n_rows, CASE WHEN metric = 'dP' THEN {_DP} ELSE {_DE} END AS band FROM m")
ORACLE["F8"] = _B_IN + f"SELECT score, n_rows, {_PRINTER} AS advice FROM b"
ORACLE["F9"] = _B_IN + f"SELECT score, n_rows, {_GUIDE} AS advice FROM b"
ORACLE["F10"] = _B_IN + f"SELECT score, n_rows, {_ACTIONS} AS actions FROM b"
ORACLE["F11"] = _B_IN + f"SELECT score, n_rows, {_VERDICT} AS verdict FROM b"


# ----------------------------------------------------------------- closed forms of the two features
FIRST = "batch = (SELECT MIN(batch) FROM li)"
LATER = "batch > (SELECT MIN(batch) FROM li)"


def two_sql(group: str, rows: str, reference: str = "is_ref") -> str:
    """CTEs up to ``s``: per group n_rows, the sample covariance of the two scaled features, its eigenvalues (l1, l2), the
    cosine of its first axis with the reference's, and the error of the reference's first axis."""
    x, c = TWO
    return f"""WITH {LI_SQL},
ref AS (SELECT AVG({x}) AS mx, STDDEV_POP({x}) AS sx, AVG({c}) AS mc, STDDEV_POP({c}) AS sc, COUNT(*) AS n, CORR({x}, {c}) AS r FROM li WHERE {reference}),
z AS (SELECT {group} AS grp, ({x} - mx) / sx AS z1, ({c} - mc) / sc AS z2 FROM li, ref WHERE {rows}),
v AS (SELECT grp, COUNT(*) AS n_rows, VAR_SAMP(z1) AS a, COVAR_SAMP(z1, z2) AS b, VAR_SAMP(z2) AS c, AVG(POW((z1 - z2), 2) / 2) / 2 AS mse FROM z GROUP BY grp),
e AS (SELECT *, (a + c) / 2 + SQRT(POW((a - c) / 2, 2) + b * b) AS l1, (a + c) / 2 - SQRT(POW((a - c) / 2, 2) + b * b) AS l2 FROM v),
s AS (SELECT *, CASE WHEN l1 / (l1 + l2) > 0.9 THEN 1 ELSE 2 END AS k_cur,
             GREATEST(100 * (1 - ABS(b + l1 - a) / SQRT(2) / SQRT(b * b + POW(l1 - a, 2))), 0) AS dp,
             ({' + '.join(f'LEAST(GREATEST({c0} + mse * ({c1} + mse * ({c2} + mse * ({c3}))), 0), 100)' for c0, c1, c2, c3 in CUBICS)}) / {len(CUBICS)} AS de FROM e)"""


_BY_REF = two_sql("CAST(is_ref AS VARCHAR)", "TRUE")
_SAMPLED = "n / (n - 1.0)"
_R = "(SELECT r FROM ref)"
ORACLE["M5"] = _BY_REF + " " + " UNION ALL ".join(
    f"SELECT {j} AS j, '{c}' AS feature, ROUND({m}, 6) AS mean, ROUND({sd}, 6) AS std, 1 AS k, n AS n_ref, ROUND(1 / SQRT(2), 9) AS loading FROM ref"
    for j, (c, m, sd) in enumerate(((TWO[0], "mx", "sx"), (TWO[1], "mc", "sc"))))
ORACLE["M6"] = _BY_REF + f""" SELECT 1 AS component, ROUND((1 + r) * {_SAMPLED}, 9) AS eigenvalue, ROUND((1 + r) / 2, 9) AS ratio,
  ROUND((1 + r) / 2, 9) AS cumulative, true AS kept FROM ref
UNION ALL SELECT 2, ROUND((1 - r) * {_SAMPLED}, 9), ROUND((1 - r) / 2, 9), 1.0, false FROM ref"""
ORACLE["M7"] = (f"WITH {LI_SQL}, {REF_STATS_SQL}, c AS (" + " UNION ALL ".join(f"SELECT {_z_sql(c)} AS v FROM li, st WHERE is_ref" for c in FEATS)
                + ") SELECT COUNT(v) AS n, ROUND(SUM(v), 4) + 0.0 AS s1, ROUND(SUM(v * v), 3) AS s2, ROUND(MIN(v), 9) AS least, "
                "ROUND(MAX(v), 9) AS most FROM c")
_LEVELS = "(SELECT i, CAST(0.01 + 0.1 * i AS DOUBLE) AS p FROM range(10) t(i))"
ORACLE["M8"] = f"SELECT ROUND(p * 100.0, 6) AS perm_pct, 10 AS n_curves, false AS guarded, true AS near FROM {_LEVELS}"
ORACLE["M8_expected"] = _BY_REF + f""" SELECT 0 AS rep, ROUND(CAST(p AS DOUBLE) * 100, 6) AS perm_pct,
  ROUND((2 - 2 * (1 - p) * (1 + r) + POW(1 - p, 2) * (1 + r) + p * (1 - p) + p) / 2, 9) AS mse, false AS guarded FROM {_LEVELS}, ref"""
ORACLE["M9"] = _BY_REF + " SELECT grp, ROUND(dp, 6) AS dp, 1 AS k_ref, k_cur, ROUND(l1 - l2, 9) AS min_eigen_gap FROM s"
ORACLE["M10"] = _BY_REF + " SELECT grp, ROUND(de, 6) AS de_pca, ROUND(mse, 9) AS mse_pca, false AS degenerate FROM s"
_SCORED = (" SELECT grp, n_rows, ROUND(dp, 6) AS dp, ROUND(de, 6) AS de_pca, CAST(NULL AS DOUBLE) AS de_ae, ROUND(mse, 9) AS mse_pca, 1 AS k_ref, "
           f"k_cur, false AS degenerate, {len(CUBICS)} AS n_curves, mse < 0 OR mse > 0.045 AS extrapolated, 0 AS n_dropped FROM s")
ORACLE["M14"] = ORACLE["S15"] = _BY_REF + _SCORED
ORACLE["M15"] = _BY_REF + " " + " UNION ALL ".join(
    f"SELECT grp, '{m}' AS metric, ROUND({v}, 6) AS value, {text.replace('score', v)} AS band, {_PRINTER.replace('score', 'de')} AS advice FROM s"
    for m, v, text in (("dP", "dp", _DP), ("dE_PCA", "de", _DE)))
_YEARLY = two_sql("CAST(batch AS VARCHAR)", LATER, FIRST)
ORACLE["M16"] = _YEARLY + " SELECT grp, n_rows, ROUND(dp, 6) AS dp, ROUND(mse, 9) AS mse_pca, ROUND(de, 6) AS de_pca FROM s"
ORACLE["W2"] = _YEARLY + """ SELECT grp, ROUND(mse, 9) AS mse_pca, ROUND(LAG(mse) OVER (ORDER BY grp), 9) AS prev_mse_pca,
  ROUND(mse - LAG(mse) OVER (ORDER BY grp), 9) + 0.0 AS delta_mse_pca FROM s"""
ORACLE["W2_series"] = """SELECT o_custkey, o_orderkey, o_totalprice, LAG(o_totalprice) OVER w AS prev_o_totalprice,
  ROUND(o_totalprice - LAG(o_totalprice) OVER w, 2) + 0.0 AS delta_o_totalprice FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)"""
ORACLE["F13"] = two_sql("'cur'", "NOT is_ref") + f""" SELECT 1 AS component, ROUND((1 + r) * {_SAMPLED}, 9) AS lambda_ref,
  ROUND(ABS(b + l1 - a) / SQRT(2) / SQRT(b * b + POW(l1 - a, 2)), 9) AS abs_cos FROM s, ref"""
_PROJECTED = " - ".join("POW(" + " + ".join(f"{w} * z{j}" for j, w in enumerate(row) if w) + ", 2)" for row in LOADINGS)
ORACLE["G2"] = ORACLE["A14"] = (
    f"WITH {LI_SQL}, {REF_STATS_SQL}, z AS (SELECT CAST(is_ref AS VARCHAR) AS grp, " + ", ".join(f"{_z_sql(c)} AS z{j}" for j, c in enumerate(FEATS))
    + f" FROM li, st) SELECT grp, COUNT(*) AS n_rows, ROUND(AVG({' + '.join(f'z{j} * z{j}' for j in range(len(FEATS)))} - {_PROJECTED}) / {len(FEATS)}, 9) "
    "AS mse_pca FROM z GROUP BY grp")
ORACLE["A15"] = _BY_REF + f" SELECT grp, ROUND(de, 6) AS de_pca, {len(CUBICS)} AS n_curves FROM s"


def _scenario_sql() -> str:
    """The five scenarios without draws: each changes the columns that ``choose_columns`` names."""
    parts = []
    for i, (name, kind, share) in enumerate(x for x in inject.SCENARIOS if x[1] in ("scale", "shift")):
        chosen = [] if share == 0.0 else inject.choose_columns(TWO, share, SEED + i)
        made = {c: c if c not in chosen else f"SIGN({c}) * POW(ABS({c}), 1.0 / 3.0)" if kind == "scale"
                else f"{c} + 2.0 * (SELECT STDDEV_SAMP({c}) FROM li WHERE is_ref)" for c in TWO}
        parts.append(f"SELECT '{name}' AS grp, ({made[TWO[0]]} - mx) / sx AS z1, ({made[TWO[1]]} - mc) / sc AS z2 FROM li, ref WHERE is_ref")
    sql = two_sql("x", "TRUE")
    a, b = sql.index("z AS (SELECT x"), sql.index("v AS (SELECT grp")
    return sql[:a] + "z AS (" + " UNION ALL ".join(parts) + "),\n" + sql[b:]


ORACLE["M17_fixed"] = _scenario_sql() + " SELECT grp, n_rows, ROUND(dp, 6) AS dp, ROUND(mse, 9) AS mse_pca FROM s"

# draws: exact counts and bounds
_CHOSEN = inject.choose_columns(FEATS, 0.5, SEED)
ORACLE["I3"] = f"WITH {LI_SQL} " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, COUNT(*) AS n_rows, {str(c in _CHOSEN).lower()} AS changed, true AS centred, true AS spread FROM li WHERE is_ref" for c in FEATS)
ORACLE["F14"] = "SELECT COUNT(*) AS n_rows, true AS centred, true AS spread, true AS all_differ FROM lineitem"
ORACLE["I4"] = (f"WITH {LI_SQL} SELECT CAST(FLOOR(COUNT(*) * 0.8) AS BIGINT) AS n_rows, CAST(FLOOR(COUNT(*) * 0.8) AS BIGINT) AS n_keys, "
                "0 AS n_stray FROM li WHERE is_ref")
ORACLE["P17"] = "SELECT COUNT(*) AS n_rows, 0 AS n_without, true AS near_share FROM orders"
ORACLE["P18"] = "SELECT COUNT(*) AS n_rows, true AS exact, 0 AS n_stray FROM orders"
