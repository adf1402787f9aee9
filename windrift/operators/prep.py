"""Feature preparation on KPI time series.

The windowed aggregation is planned in *eager* form by default: KPI rows are
first reduced per ``(window, CELL)`` (map-side partial aggregation, one
shuffle of already-combined rows), and only the small per-window result is
joined to the neighbour relation.  The literal form (join first, fan out,
then aggregate) is kept as ``mode="literal"``; both give identical numbers.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windrift.functions.columns import or_zero, qcol
from windrift.sources.schemas import OVERLAP_PCT

KEY_COLUMNS = ("window", "window_start", "window_end", "window_date", "CELL", "N_CELL")

# Raw header variants and the name each maps to, in priority order.
DEFAULT_ALIASES: dict[str, list[str]] = {
    "CELL": ["SectorID", "SITE"],
    "Traffic_Volume_Gbyte": ["Traffic Volume Gbyte"],
}


# --------------------------------------------------------------------------- P1, P2
def harmonize_names(df: DataFrame, aliases: Mapping[str, Sequence[str]] = DEFAULT_ALIASES) -> DataFrame:
    """Rename the first present variant to the canonical name.

    A canonical name already present wins; variants are tried in order.
    """
    renames: dict[str, str] = {}
    cols = set(df.columns)
    for target, variants in aliases.items():
        if target in cols:
            continue
        for v in variants:
            if v in cols:
                renames[v] = target
                break
    return df.withColumnsRenamed(renames) if renames else df


def rename_if_present(df: DataFrame, old: str, new: str) -> DataFrame:
    """Unconditional rename; silently a no-op when ``old`` is absent."""
    return df.withColumnRenamed(old, new)


# --------------------------------------------------------------------------- P3, P4
def filter_overlap(overlap: DataFrame, threshold: float = 40.0, pct_col: str = OVERLAP_PCT) -> DataFrame:
    """Keep neighbour pairs with overlap ``>= threshold`` (inclusive; NULL
    overlap is dropped, D2).  Pushed to the scan as a data filter."""
    return overlap.filter(qcol(pct_col) >= F.lit(float(threshold)))


def neighbour_pairs(overlap: DataFrame) -> DataFrame:
    """Prune the build side to ``(CELL, N_CELL)``."""
    return overlap.select("CELL", "N_CELL")


# --------------------------------------------------------------------------- broadcast guard
_TYPE_BYTES = {"byte": 1, "short": 2, "integer": 4, "long": 8, "float": 4, "double": 8, "boolean": 1,
               "date": 4, "timestamp": 8, "timestamp_ntz": 8, "string": 20}


def _row_bytes(schema: T.StructType) -> int:
    """Row width estimate (Spark's default sizes; 20 bytes per string, 16 per
    decimal, 64 per nested value)."""
    total = 0
    for f in schema.fields:
        name = f.dataType.typeName()
        total += _TYPE_BYTES.get(name, 16 if name == "decimal" else 64)
    return max(8, total)


def bounded_broadcast(df: DataFrame, max_bytes: int = 64 << 20, known_rows: int | None = None) -> DataFrame:
    """Broadcast ``df`` only when its size is known to be below ``max_bytes``.

    Without a known row count the frame is returned unhinted: nothing is run to
    measure it, and AQE turns the join into a broadcast from the real size of
    its shuffle.
    """
    if known_rows is not None and known_rows * _row_bytes(df.schema) <= max_bytes:
        return F.broadcast(df)
    return df


# --------------------------------------------------------------------------- J1, J2
def _left_join(kpi: DataFrame, right: DataFrame, how: str, salts: int, max_bytes: int) -> DataFrame:
    """``kpi ⟕ right`` on CELL, where ``right`` has a bounded number of rows a cell.

    ``auto``: Spark plans the join, AQE splits partitions that turn out skewed.  ``merge``: a sort-merge join.
    ``salted``: the rows of every cell are dealt to ``salts`` tasks by a hash of the row, and the bounded right side is
    repeated for each, so a cell that holds a third of all rows is spread without counting cells first.
    """
    if how == "auto":
        return kpi.join(bounded_broadcast(right, max_bytes), "CELL", "left")
    if how == "merge":
        return kpi.join(right.hint("merge"), "CELL", "left")
    if how == "salted":
        salt = F.pmod(F.xxhash64(*[qcol(c) for c in kpi.columns]), F.lit(salts)).cast("int")
        spread = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        return kpi.withColumn("_salt", salt).join(spread.hint("merge"), ["CELL", "_salt"], "left").drop("_salt")
    raise ValueError(f"unknown join {how!r}")


def join_neighbours(kpi: DataFrame, neighbours: DataFrame, broadcast_max_bytes: int = 64 << 20, how: str = "auto",
                    salts: int = 16) -> DataFrame:
    """``kpi ⟕ neighbours`` on CELL; fans out one row per neighbour, cells
    without any keep ``N_CELL = NULL`` (D3)."""
    return _left_join(kpi, neighbour_pairs(neighbours), how, salts, broadcast_max_bytes)


def join_overlap_whole(kpi: DataFrame, overlap: DataFrame, broadcast_max_bytes: int = 64 << 20, how: str = "auto",
                       salts: int = 16) -> DataFrame:
    """``kpi ⟕ overlap`` on CELL with every overlap column, no threshold."""
    return _left_join(kpi, overlap, how, salts, broadcast_max_bytes)


# --------------------------------------------------------------------------- W1
_UNITS = {"second": "s", "minute": "m", "hour": "h", "day": "d", "week": "w"}


def width_suffix(width: str) -> str:
    """``"8 hours"`` → ``"8h"`` (D11: the alias suffix follows the width)."""
    m = re.fullmatch(r"\s*(\d+)\s*([a-zA-Z]+?)s?\s*", width)
    if not m:
        raise ValueError(f"cannot read window width {width!r}")
    unit = m.group(2).lower()
    if unit not in _UNITS:
        raise ValueError(f"unknown unit in {width!r}")
    return f"{m.group(1)}{_UNITS[unit]}"


def add_time_bucket(df: DataFrame, ts: str = "DATETIME", width: str = "8 hours",
                    start_time: str | None = None) -> DataFrame:
    """Tumbling event-time bucket as flat ``window_start`` / ``window_end``.

    Buckets are aligned to 1970-01-01 in the session time zone (pin UTC, D5);
    rows with NULL time are dropped, as a grouping on ``window()`` does (D6).
    """
    w = F.window(qcol(ts), width, startTime=start_time) if start_time else F.window(qcol(ts), width)
    return (df.filter(qcol(ts).isNotNull())
              .withColumn("_w", w)
              .withColumn("window_start", F.col("_w.start"))
              .withColumn("window_end", F.col("_w.end"))
              .drop("_w"))


# --------------------------------------------------------------------------- A1, A2 spec
@dataclass(frozen=True)
class FeatureSpec:
    alias_stem: str   # alias without the width suffix
    source: str       # KPI column
    agg: str = "avg"  # "avg" or "sum"

    def alias(self, suffix: str) -> str:
        return f"{self.alias_stem}_{suffix}"


def _spec(rows: Iterable[tuple[str, str, str]]) -> list[FeatureSpec]:
    return [FeatureSpec(a, s, g) for a, s, g in rows]


# The three-feature windowed set (alias stem, source, aggregate).
BASIC_SPEC = _spec([
    ("avg_traffic", "Traffic_Volume_Gbyte", "avg"),
    ("avg_erab_drop_rate", "ERAB_Drop_PC", "avg"),
    ("avg_rrc_users", "Nof_Avg_SimRRC_ConnUsr", "avg"),
])

# The full windowed feature set.  The three interference
# "max"/"min" names are averages of the Max/Min columns, as produced.
FULL_SPEC = _spec([
    ("avg_traffic_volume_gbyte", "Traffic_Volume_Gbyte", "avg"),
    ("sum_traffic_volume_gbyte", "Traffic_Volume_Gbyte", "sum"),
    ("avg_erab_drop_rate", "ERAB_Drop_PC", "avg"),
    ("avg_erab_estab_attempts", "ERAB_ESTAB_ATT", "avg"),
    ("avg_erab_setup_success_rate", "E-RAB_SETUP_SUCCESS_RATE", "avg"),
    ("avg_rrc_users", "Nof_Avg_SimRRC_ConnUsr", "avg"),
    ("avg_rrc_estab_success_rate", "RRC_EstabSucc_PC", "avg"),
    ("avg_rrc_attempts", "NUM_OF_RRC_Att", "avg"),
    ("avg_sim_rrc_conn_count", "AVG_SimRRC_ConnUsr_COUNT", "avg"),
    ("avg_ho_success_in", "HO_Succ_PC_In", "avg"),
    ("avg_intrafreq_ho_sr", "INTRAFREQ_HO_SR", "avg"),
    ("avg_interfreq_ho_sr", "INTERFREQ_HO_SR", "avg"),
    ("avg_dl_prb_utilization", "DLPRBUtilization", "avg"),
    ("avg_ul_prb_utilization", "UL_PRB_Util_%", "avg"),
    ("avg_dl_prb_util_hwi", "DL_PRB_Util_%_HWI", "avg"),
    ("avg_volte_traffic_erl", "VOLTE_TRAFFIC_ERL", "avg"),
    ("avg_ul_interference", "L.UL.Interference.Avg", "avg"),
    ("max_ul_interference", "L.UL.Interference.Max", "avg"),
    ("min_ul_interference", "L.UL.Interference.Min", "avg"),
    ("avg_rssi_pucch", "AVGUL_RSSI_WEIGH_DBM_PUCCH", "avg"),
    ("avg_rssi_pusch", "AVGUL_RSSI_WEIGH_DBM_PUSCH", "avg"),
    ("avg_rsrp_pucch", "Avg_UL_RSRP_PUCCH", "avg"),
    ("avg_rsrp_pusch", "Avg_UL_RSRP_PUSCH", "avg"),
    ("avg_cqi", "Avg_CQI_HWI", "avg"),
    ("avg_ul_packet_loss", "UL_PACKET_LOSS", "avg"),
])


def resolve_spec(df: DataFrame, spec: Sequence[FeatureSpec], strict: bool = False
                 ) -> tuple[list[FeatureSpec], list[str]]:
    """Keep the spec entries whose source exists; return them and the missing
    sources.  ``strict`` raises instead of skipping."""
    cols = set(df.columns)
    present = [s for s in spec if s.source in cols]
    missing = sorted({s.source for s in spec if s.source not in cols})
    if strict and missing:
        raise ValueError(f"missing KPI columns: {missing}")
    if not present:
        raise ValueError("none of the feature sources is present")
    return present, missing


def watch_sources(kpi: DataFrame, spec: Sequence[FeatureSpec], observation: Observation) -> DataFrame:
    """``kpi`` that counts, in the pass that reads it anyway, its rows and the values of every source it has."""
    sources = sorted({s.source for s in spec} & set(kpi.columns))
    return kpi.observe(observation, F.count(F.lit(1)).alias("rows"), *[F.count(qcol(s)).alias(f"s{i}") for i, s in enumerate(sources)])


def feature_report(spark: SparkSession, columns: Sequence[str], spec: Sequence[FeatureSpec], suffix: str,
                   observation: Observation | None = None) -> DataFrame:
    """``(feature, source, present, n_values)`` of every feature of the spec.  ``n_values`` counts the non-null
    values that ``watch_sources`` has seen (0 of an absent source, NULL if nothing was watched); it is there once an
    action has read the rows."""
    have = set(columns)
    order = {s: i for i, s in enumerate(sorted({x.source for x in spec} & have))}
    seen = observation.get if observation is not None else None
    rows = [(x.alias(suffix), x.source, x.source in have,
             None if seen is None else int(seen[f"s{order[x.source]}"]) if x.source in order else 0) for x in spec]
    return spark.createDataFrame(rows, "feature string, source string, present boolean, n_values long")


def sum_expr(src: str, exact_scale: int | None) -> Column:
    c = qcol(src)
    if exact_scale is not None:
        return F.sum(c.cast(T.DecimalType(18, exact_scale)))
    return F.sum(c.cast("double"))


def windowed_features(kpi: DataFrame, neighbours: DataFrame | None, spec: Sequence[FeatureSpec] = FULL_SPEC,
                      width: str = "8 hours", ts: str = "DATETIME", start_time: str | None = None,
                      mode: str = "eager", exact_scale: int | None = None, strict: bool = False,
                      broadcast_max_bytes: int = 64 << 20, observation: Observation | None = None) -> DataFrame:
    """A1 / A2: per ``(window, CELL, N_CELL)`` aggregates named by the spec.

    ``neighbours`` is the filtered ``(CELL, N_CELL)`` relation (P3 + P4), or
    None for no neighbour key.  ``exact_scale`` sums fixed-point measurements
    as decimals (order-independent, bit-identical across engines and retries).
    Output: ``window_start, window_end, CELL, N_CELL, <aliases>`` unfilled.  Features
    without a source are left out; ``feature_report`` names them, with the values
    counted by ``observation`` in the same pass.
    """
    present, _ = resolve_spec(kpi, spec, strict)
    if observation is not None:
        kpi = watch_sources(kpi, spec, observation)
    suffix = width_suffix(width)
    sources = sorted({s.source for s in present})
    bucketed = add_time_bucket(kpi.select(qcol(ts).alias("_ts"), "CELL", *[qcol(s) for s in sources]),
                               "_ts", width, start_time)
    src_id = {s: f"_s{i}" for i, s in enumerate(sources)}

    def partials(df: DataFrame, keys: list[str]) -> DataFrame:
        aggs = []
        for s in sources:
            aggs.append(sum_expr(s, exact_scale).alias(src_id[s] + "_sum"))
            aggs.append(F.count(qcol(s)).alias(src_id[s] + "_cnt"))
        return df.groupBy(*keys).agg(*aggs)

    if neighbours is None:
        grouped = partials(bucketed, ["window_start", "window_end", "CELL"]) \
            .withColumn("N_CELL", F.lit(None).cast("string")).withColumn("_m", F.lit(1))
    elif mode == "literal":
        joined = bucketed.join(bounded_broadcast(neighbour_pairs(neighbours), broadcast_max_bytes), "CELL", "left")
        grouped = partials(joined, ["window_start", "window_end", "CELL", "N_CELL"]).withColumn("_m", F.lit(1))
    elif mode == "eager":
        # Multiplicity of each (CELL, N_CELL) pair: duplicates multiply sums.
        mult = neighbour_pairs(neighbours).groupBy("CELL", "N_CELL").agg(F.count(F.lit(1)).alias("_m"))
        per_cell = partials(bucketed, ["window_start", "window_end", "CELL"])
        grouped = (per_cell.join(bounded_broadcast(mult, broadcast_max_bytes), "CELL", "left")
                   .withColumn("_m", F.coalesce(F.col("_m"), F.lit(1))))
    else:
        raise ValueError(f"unknown mode {mode!r}")

    m = F.col("_m")
    outs = []
    for s in present:
        total = F.col(src_id[s.source] + "_sum") * m
        cnt = F.col(src_id[s.source] + "_cnt") * m
        if s.agg == "sum":
            val = total.cast("double")
        elif s.agg == "avg":
            val = total.cast("double") / F.nullif(cnt, F.lit(0))
        else:
            raise ValueError(f"unknown aggregate {s.agg!r}")
        outs.append(val.alias(s.alias(suffix)))
    return grouped.select("window_start", "window_end", "CELL", "N_CELL", *outs)


# --------------------------------------------------------------------------- P6
def fill_numeric_zero(df: DataFrame, keys: Sequence[str] = KEY_COLUMNS) -> DataFrame:
    """NULL and NaN → 0 in numeric feature columns; strings, structs and
    the key columns (a NULL neighbour must stay NULL) are untouched (D7)."""
    subset = [c for c, t in df.dtypes if c not in keys
              and (t in ("int", "bigint", "smallint", "tinyint", "float", "double") or t.startswith("decimal"))]
    return df.na.fill(0, subset=subset) if subset else df


def fill_features(df: DataFrame, how: str = "zero", keys: Sequence[str] = KEY_COLUMNS) -> DataFrame:
    """``zero`` (as produced), ``none``, or ``mean`` (column mean over the
    whole table, one aggregate pass)."""
    if how == "zero":
        return fill_numeric_zero(df, keys)
    if how == "none":
        return df
    if how == "mean":
        feats = feature_columns(df, keys)
        means = df.agg(*[F.avg(qcol(c)).alias(c) for c in feats]).first().asDict()
        return df.na.fill({c: v for c, v in means.items() if v is not None})
    raise ValueError(how)


# --------------------------------------------------------------------------- P7-P11, P13
def project_ml_ready(df: DataFrame, features: str = "features") -> DataFrame:
    """``(window_start, window_end, CELL, N_CELL, features)``."""
    return df.select("window_start", "window_end", "CELL", "N_CELL", features)


def project_features_label(df: DataFrame, features: str, label: str) -> DataFrame:
    """P8."""
    return df.select(features, label)


NUMERIC_RULE_TYPES = ("int", "double", "float")


def numeric_columns(df: DataFrame, types: Sequence[str] = NUMERIC_RULE_TYPES) -> tuple[list[str], str]:
    """Numeric columns by dtype; the last one is the label (D20: bigint is
    not numeric under the reference rule; pass ``types`` to widen it)."""
    nums = [c for c, t in df.dtypes if t in types]
    if len(nums) < 2:
        raise ValueError("need at least one feature and a label")
    return nums[:-1], nums[-1]


def select_features(df: DataFrame, wanted: Sequence[str], strict: bool = False) -> tuple[list[str], DataFrame]:
    """P10: wanted ∩ available in wanted order, plus a ``(feature, present)``
    report table; raises when nothing is left (D12-D14)."""
    available = set(df.columns)
    valid = [c for c in wanted if c in available]
    report = df.sparkSession.createDataFrame([(c, c in available) for c in wanted], "feature string, present boolean")
    missing = [c for c in wanted if c not in available]
    if strict and missing:
        raise ValueError(f"missing features: {missing}")
    if not valid:
        raise ValueError("no valid feature found in the input")
    return valid, report


def feature_columns(df: DataFrame, keys: Sequence[str] = KEY_COLUMNS) -> list[str]:
    """Every column except the keys."""
    return [c for c in df.columns if c not in keys]


def drop_first_column(df: DataFrame) -> DataFrame:
    """Drop the leading (date) column, keep the numeric rest."""
    return df.drop(df.columns[0])


# --------------------------------------------------------------------------- quality
def kpi_quality(kpi: DataFrame, ts: str = "DATETIME", corrupt: str = "_corrupt_record") -> DataFrame:
    """One row of input counts: all rows, rows without time (dropped by the
    windowing, D6), rows without cell, and malformed lines kept by a
    PERMISSIVE read (0 when the read did not keep them)."""
    aggs = [F.count(F.lit(1)).alias("n_rows"),
            F.count_if(qcol(ts).isNull()).alias("null_time"),
            F.count_if(F.col("CELL").isNull()).alias("null_cell")]
    aggs.append(F.count_if(qcol(corrupt).isNotNull()).alias("corrupt") if corrupt in kpi.columns
                else F.lit(0).cast("long").alias("corrupt"))
    return kpi.agg(*aggs)


# --------------------------------------------------------------------------- A3-A9, T1
def fanout_totals(kpi: DataFrame, overlap: DataFrame, exact_scale: int | None = None,
                  broadcast_max_bytes: int = 64 << 20) -> DataFrame:
    """A3 as produced (D4): totals over ``kpi ⟕ overlap``, each KPI row counted
    once per matching overlap row.

    Planned eagerly: per-CELL partial sums joined to the per-CELL overlap row
    count, so the fan-out is never materialised.
    """
    srcs = ["Traffic_Volume_Gbyte", "ERAB_Drop_PC", "Nof_Avg_SimRRC_ConnUsr"]
    per_cell = kpi.groupBy("CELL").agg(*[x for s in srcs for x in (
        sum_expr(s, exact_scale).alias(f"{s}_sum"), F.count(qcol(s)).alias(f"{s}_cnt"))])
    mult = overlap.groupBy("CELL").agg(F.count(F.lit(1)).alias("_m"))
    j = (per_cell.join(bounded_broadcast(mult, broadcast_max_bytes), "CELL", "left")
         .withColumn("_m", F.coalesce(F.col("_m"), F.lit(1))))
    m = F.col("_m")
    agg = j.agg(*[x for s in srcs for x in (F.sum(F.col(f"{s}_sum") * m).alias(f"{s}_sum"),
                                              F.sum(F.col(f"{s}_cnt") * m).alias(f"{s}_cnt"))])
    tr, dr, us = srcs
    return agg.select(
        F.col(f"{tr}_sum").cast("double").alias("total_traffic"),
        (F.col(f"{dr}_sum").cast("double") / F.nullif(F.col(f"{dr}_cnt"), F.lit(0))).alias("avg_drop_rate"),
        (F.col(f"{us}_sum").cast("double") / F.nullif(F.col(f"{us}_cnt"), F.lit(0))).alias("avg_users"),
    )


def drift_means(windowed: DataFrame, width: str = "8 hours") -> DataFrame:
    """A4: global means of two windowed features; NULL → 0.0."""
    suffix = width_suffix(width)
    traffic, drop = f"avg_traffic_volume_gbyte_{suffix}", f"avg_erab_drop_rate_{suffix}"
    return windowed.agg(F.avg(qcol(traffic)).alias("traffic"), F.avg(qcol(drop)).alias("drop")) \
        .select(or_zero("traffic").alias("traffic"), or_zero("drop").alias("drop"))


def neighbour_overlap_avg(overlap: DataFrame, pct_col: str = OVERLAP_PCT) -> DataFrame:
    """A5: mean overlap per neighbour cell."""
    return overlap.groupBy("N_CELL").agg(F.avg(qcol(pct_col)).alias("avg_overlap_pct"))


def top_neighbours(overlap: DataFrame, n: int = 10, pct_col: str = OVERLAP_PCT) -> DataFrame:
    """The ``n`` neighbours with the highest mean overlap (tie-break on
    N_CELL so the answer is deterministic).  Planned as a partial aggregate
    plus ``TakeOrderedAndProject``: only ``n`` rows per task reach the final
    merge."""
    return neighbour_overlap_avg(overlap, pct_col).orderBy(F.desc("avg_overlap_pct"), F.asc("N_CELL")).limit(n)


def global_overlap_avg(overlap: DataFrame, pct_col: str = OVERLAP_PCT) -> DataFrame:
    """A6."""
    return overlap.agg(F.avg(qcol(pct_col)).alias("avg_overlap_pct"))


def row_count(df: DataFrame) -> DataFrame:
    """A7 as a one-row frame (stays lazy)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


def column_sum(df: DataFrame, col: str, alias: str = "total") -> DataFrame:
    """A8."""
    return df.agg(F.sum(qcol(col)).alias(alias))


def shape(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rows and (feature) columns of a frame, one row."""
    n_cols = len([c for c in df.columns if c not in keys])
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(n_cols))
