"""Adapters from the shipped tables to the shapes the operators expect.

The reference reads cellular KPI CSVs, an overlap relation and numeric
frames.  The shipped tables are mapped onto those shapes with plain column
expressions, so every operator runs on whole tables and its work grows with
them.  The mapping rules are fixed and mirrored by the DuckDB oracle SQL in
``windrift.registry``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the fixture mapping.
NEIGHBOUR_STEPS = (1, 2, 3)  # a cell's candidates lie so far below and above it: at most six, whatever the data's size
N_SERIES = 20                # series of the wide CSV: user_id % 20
SPLIT_DATE = "1998-06-01"    # lineitem reference / current cut
EMB_SPLIT_LABEL = 5          # embeddings reference: label < 5
EMB_DIM = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


# Stable row identity of a Parquet row: hash of its file and its position in
# the file.  Unlike ``monotonically_increasing_id`` it does not change when a
# task is recomputed, so hash-seeded choices stay the same after a retry.
ROW_KEY = ["rid_file", "rid_row"]


def row_key_columns() -> list:
    return [F.xxhash64(F.col("_metadata.file_path")).alias("rid_file"),
            F.col("_metadata.row_index").alias("rid_row")]


def kpi_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1: events → KPI rows with the reference column names; a cell is a user."""
    return kpi_rows(table(spark, sf_dir, "events"))


def _drop_rate():
    return (F.when(F.col("event_type") == "error", F.lit(100).cast("double"))
            .when(F.col("event_type") != "view", F.lit(0).cast("double")))


def kpi_rows(ev: DataFrame) -> DataFrame:
    """B1 mapping of any events frame (batch or stream)."""
    return ev.select(*kpi_columns())


def _where(condition: str, column: str) -> str:
    return f"CASE WHEN {condition} THEN {column} END"


# The sources of the full feature set that orders and line items give, as SQL.
WIDE_SOURCES: dict[str, str] = {
    "ERAB_ESTAB_ATT": "o_custkey",
    "E-RAB_SETUP_SUCCESS_RATE": "CASE o_orderstatus WHEN 'F' THEN 100 WHEN 'O' THEN 0 END",
    "RRC_EstabSucc_PC": "o_totalprice",
    "NUM_OF_RRC_Att": "CAST(left(o_orderpriority, 1) AS INT)",
    "AVG_SimRRC_ConnUsr_COUNT": "l_linenumber",
    "HO_Succ_PC_In": "l_discount",
    "INTRAFREQ_HO_SR": "l_tax",
    "INTERFREQ_HO_SR": _where("l_returnflag = 'R'", "l_discount"),
    "DLPRBUtilization": "l_quantity",
    "UL_PRB_Util_%": _where("l_linestatus = 'O'", "l_quantity"),
    "DL_PRB_Util_%_HWI": _where("l_linestatus = 'F'", "l_quantity"),
    "VOLTE_TRAFFIC_ERL": _where("event_type = 'purchase'", "value"),
    "L.UL.Interference.Avg": "l_extendedprice",
    "L.UL.Interference.Max": _where("l_returnflag = 'A'", "l_extendedprice"),
    "L.UL.Interference.Min": _where("l_returnflag = 'N'", "l_extendedprice"),
    "AVGUL_RSSI_WEIGH_DBM_PUCCH": "l_suppkey",
    "AVGUL_RSSI_WEIGH_DBM_PUSCH": "l_partkey",
    "Avg_UL_RSRP_PUCCH": _where("event_type = 'click'", "l_tax"),
    "Avg_UL_RSRP_PUSCH": _where("event_type = 'signup'", "l_discount"),
    "Avg_CQI_HWI": _where("o_orderstatus = 'P'", "o_totalprice"),
    "UL_PACKET_LOSS": _where("event_type = 'error'", "l_extendedprice"),
}


def kpi_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KPI rows with all 24 sources of the full feature set: each event with the order and the line items of its number.
    Both joins share their key, so each table is shuffled once; unmatched rows have NULL sources."""
    ev, orders, lines = (table(spark, sf_dir, t) for t in ("events", "orders", "lineitem"))
    rows = ev.join(orders, ev["event_id"] == orders["o_orderkey"], "left").join(
        lines, ev["event_id"] == lines["l_orderkey"], "left")
    return rows.select(*kpi_columns(), *[F.expr(e).cast("double").alias(n) for n, e in WIDE_SOURCES.items()])


def kpi_columns() -> list:
    """The three-measure KPI columns of an events row."""
    return [F.col("ts").alias("DATETIME"), F.col("user_id").cast("int").alias("CELL"),
            F.col("value").alias("Traffic_Volume_Gbyte"), _drop_rate().alias("ERAB_Drop_PC"),
            F.get_json_object("props", "$.k").try_cast("double").alias("Nof_Avg_SimRRC_ConnUsr")]


def overlap_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2: overlap relation over the cells present in ``events``, at most six neighbours a cell.

    Every cell proposes its pairs; a pair of two present cells is proposed from both ends, so counting the proposals
    replaces a join of the cells with themselves and ``events`` is read once.
    """
    cells = table(spark, sf_dir, "events").select(F.col("user_id").cast("int").alias("c")).filter("c IS NOT NULL").distinct()
    other = F.explode(F.array(*[F.col("c") + F.lit(s * k) for k in NEIGHBOUR_STEPS for s in (-1, 1)]))
    pairs = cells.select("c", other.alias("n")).groupBy(F.least("c", "n").alias("lo"), F.greatest("c", "n").alias("hi")) \
        .agg(F.count(F.lit(1)).alias("k")).filter("k = 2")
    both = pairs.select(F.inline(F.array(F.struct(F.col("lo").alias("CELL"), F.col("hi").alias("N_CELL")),
                                         F.struct(F.col("hi").alias("CELL"), F.col("lo").alias("N_CELL")))))
    c, n = F.col("CELL"), F.col("N_CELL")
    pct = F.when(c % 7 == 0, (c * 37 + n * 11) % 40).otherwise((c * 37 + n * 11) % 61).cast("double")
    return both.select("CELL", "N_CELL", pct.alias("Overlap_Alan%"))


# Names of the derived lineitem drift features (B3 row 1).
LINEITEM_FEATURES = ["l_quantity", "l_extendedprice", "disc_price", "charge",
                     "l_discount", "tax_amt", "disc_amt"]
LINEITEM_RAW_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def lineitem_features(spark: SparkSession, sf_dir: str, with_keys: bool = True) -> DataFrame:
    """B3 row 1: seven numeric features from lineitem plus keys and split flag."""
    return lineitem_feature_rows(table(spark, sf_dir, "lineitem"), with_keys, with_keys)


def lineitem_feature_rows(li: DataFrame, with_keys: bool = True, with_row_key: bool = False) -> DataFrame:
    """B3 row 1 mapping of any lineitem frame (batch or stream)."""
    ext, disc, tax = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")
    cols = [
        F.col("l_quantity"), ext.alias("l_extendedprice"),
        (ext * (1 - disc)).alias("disc_price"),
        (ext * (1 - disc) * (1 + tax)).alias("charge"),
        disc.alias("l_discount"),
        (ext * tax).alias("tax_amt"),
        (ext * disc).alias("disc_amt"),
    ]
    keys = []
    if with_keys:
        keys = [*(row_key_columns() if with_row_key else []), F.col("l_orderkey"), F.col("l_linenumber"),
                (F.col("l_shipdate") < F.lit(SPLIT_DATE).cast("timestamp_ntz")).alias("is_ref"),
                F.year("l_shipdate").alias("batch")]
    return li.select(*keys, *cols)


def lineitem_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B3 row 2: four raw lineitem columns (nearly uncorrelated, k = d)."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(*row_key_columns(), "l_orderkey", "l_linenumber",
                     (F.col("l_shipdate") < F.lit(SPLIT_DATE).cast("timestamp_ntz")).alias("is_ref"),
                     *LINEITEM_RAW_FEATURES)


def embedding_features(spark: SparkSession, sf_dir: str, dim: int = EMB_DIM) -> DataFrame:
    """B3 row 3: embedding vector spread to ``e0..e{dim-1}`` doubles."""
    emb = table(spark, sf_dir, "embeddings")
    return emb.select(
        "vec_id", "label", (F.col("label") < EMB_SPLIT_LABEL).alias("is_ref"),
        *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(dim)])


def embedding_names(dim: int = EMB_DIM) -> list[str]:
    return [f"e{i}" for i in range(dim)]


def split_ref_current(df: DataFrame, flag: str = "is_ref") -> tuple[DataFrame, DataFrame]:
    return df.filter(F.col(flag)), df.filter(~F.col(flag))
