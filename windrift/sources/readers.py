"""Readers and writers.

CSV is the reference's input format; Parquet the format between stages.
Declared schemas (S2, S3) are preferred: inference costs a full extra scan
per file, which at 100 TB is a whole job of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from windrift.functions.columns import qcol
from windrift.sources.schemas import (
    INDEX_COLUMNS, KPI_TIMESTAMP_FORMAT, kpi_schema, overlap_schema,
)


CORRUPT = "_corrupt_record"


def drop_index_columns(df: DataFrame) -> DataFrame:
    """Drop an unnamed leading index column under either of its names."""
    return df.drop(*[c for c in INDEX_COLUMNS if c in df.columns])


def read_kpi_csv_inferred(spark: SparkSession, path: str,
                          timestamp_format: str | None = KPI_TIMESTAMP_FORMAT) -> DataFrame:
    """Header CSV with inferred types (costs one inference scan)."""
    reader = spark.read.option("header", True).option("inferSchema", True)
    if timestamp_format:
        reader = reader.option("timestampFormat", timestamp_format)
    return reader.csv(path)


def read_kpi_csv(spark: SparkSession, path: str, schema: T.StructType | None = None,
                 timestamp_format: str = KPI_TIMESTAMP_FORMAT,
                 keep_corrupt: bool = False) -> DataFrame:
    """KPI CSV with the declared schema, PERMISSIVE; malformed lines can be
    kept in ``_corrupt_record`` for the quality report."""
    schema = schema or kpi_schema(with_corrupt=keep_corrupt)
    reader = (spark.read.schema(schema).option("header", True)
              .option("mode", "PERMISSIVE").option("timestampFormat", timestamp_format))
    if not keep_corrupt:
        return reader.csv(path)
    df = reader.option("columnNameOfCorruptRecord", CORRUPT).csv(path)
    # a field is converted, and found malformed, only if the query reads it: the record stands on all of them
    every = F.hash(*[qcol(c) for c in df.columns if c != CORRUPT])
    return df.withColumn(CORRUPT, F.when(F.pmod(every, F.lit(2)) < 2, F.col(CORRUPT)))


def read_overlap_csv(spark: SparkSession, path: str, schema: T.StructType | None = None,
                     has_index: bool = True) -> DataFrame:
    """S3: overlap relation; the leading index column is dropped by either name."""
    if schema is None:
        schema = overlap_schema(with_index=has_index)
    df = spark.read.schema(schema).option("header", True).csv(path)
    return drop_index_columns(df)


def read_wide_series_csv(spark: SparkSession, path: str, date_col: str | None = None,
                         date_format: str | None = None) -> DataFrame:
    """First column is a date, the rest numeric (one column per series).

    The date column is parsed with ``to_date``; every other column is read as
    double.  One small sampling read finds the header only.
    """
    header = spark.read.option("header", True).csv(path).columns
    date_col = date_col or header[0]
    schema = T.StructType([T.StructField(c, T.StringType() if c == date_col else T.DoubleType(), True)
                           for c in header])
    df = spark.read.schema(schema).option("header", True).csv(path)
    parsed = F.to_date(F.col(f"`{date_col}`"), date_format) if date_format else F.to_date(F.col(f"`{date_col}`"))
    return df.withColumn(date_col, parsed)


def read_stage_parquet(spark: SparkSession, path: str, stage_hint: str = "the producing stage") -> DataFrame:
    """Read the Parquet written by an earlier stage, with guidance when absent."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as exc:  # path missing or unreadable
        raise FileNotFoundError(f"no Parquet at {path}; run {stage_hint} first") from exc


def write_windowed_parquet(df: DataFrame, path: str, partition_by_date: bool = True) -> None:
    """Overwrite the windowed features, partitioned by window date so later
    reads of a date range prune whole folders."""
    out = df
    if partition_by_date and "window_start" in df.columns:
        out = df.withColumn("window_date", F.to_date("window_start"))
        out.write.mode("overwrite").partitionBy("window_date").parquet(path)
    else:
        out.write.mode("overwrite").parquet(path)


def write_vectors_parquet(df: DataFrame, path: str, vector_cols: Sequence[str] = ("features",),
                          partition_by_date: bool = True) -> None:
    """ML-ready rows with vectors stored as ``array<double>`` (portable)."""
    from pyspark.ml.functions import vector_to_array

    out = df
    for c in vector_cols:
        if c in out.columns:
            out = out.withColumn(c, vector_to_array(F.col(c)))
    write_windowed_parquet(out, path, partition_by_date=partition_by_date)


def write_single_csv(df: DataFrame, path: str) -> None:
    """A small result as one CSV file with header (no trip through the driver)."""
    df.repartition(1).write.mode("overwrite").option("header", True).csv(path)  # coalesce(1) would compute it in one task


def frame_from_rows(spark: SparkSession, rows: Sequence[Sequence], names: Sequence[str] | str) -> DataFrame:
    """DataFrame from in-memory rows (small inputs, tests)."""
    return spark.createDataFrame(list(rows), names if isinstance(names, str) else list(names))
