"""Structured Streaming jobs.

X1 computes the windowed KPI features on an unbounded file stream: the
aggregation keeps state per (window, CELL), bounded by the watermark, append mode
emits each window once, after it has closed, and only then is it joined to the
static neighbour relation.  So the fan-out never enters the state.

X2 scores each micro-batch against a saved drift model inside
``foreachBatch``; each batch overwrites its own partition of the history, so a
replayed batch adds nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrift.functions.columns import qcol
from windrift.operators import prep
from windrift.plans import detector as det
from windrift.plans import report


def file_stream(spark: SparkSession, folder: str, glob: str | None = None, max_files: int | None = None) -> DataFrame:
    """Parquet files arriving in ``folder`` (schema from the current files'
    footers; a stream needs it declared)."""
    reader = spark.read
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    schema = reader.parquet(folder).schema
    rs = spark.readStream.schema(schema)
    if glob:
        rs = rs.option("pathGlobFilter", glob)
    if max_files:
        rs = rs.option("maxFilesPerTrigger", max_files)
    return rs.parquet(folder)


def windowed_stream(kpi_stream: DataFrame, neighbours: DataFrame | None, spec: Sequence[prep.FeatureSpec],
                    width: str = "8 hours", watermark: str = "8 hours", ts: str = "DATETIME",
                    exact_scale: int | None = None, ntz_output: bool = True) -> DataFrame:
    """Streaming form of the windowed features.  ``ts`` is cast to
    ``timestamp`` (watermarks reject ``timestamp_ntz``); window bounds go out
    as ``timestamp_ntz`` again so batch and stream results have one type.
    ``exact_scale`` sums fixed-point values as decimals, as the batch job."""
    present, _ = prep.resolve_spec(kpi_stream, spec)
    suffix = prep.width_suffix(width)
    tz = kpi_stream.sparkSession.conf.get("spark.sql.session.timeZone")
    # wall-clock time as a UTC instant, so windows align as in the batch job
    # whatever the session zone
    s = kpi_stream.withColumn(ts, F.from_utc_timestamp(qcol(ts).cast("timestamp"), tz)).withWatermark(ts, watermark)
    sources = sorted({sp.source for sp in present})
    aggs = []
    for i, src in enumerate(sources):
        aggs.append(prep.sum_expr(src, exact_scale).alias(f"_s{i}"))
        aggs.append(F.count(qcol(src)).alias(f"_c{i}"))
    # state is kept per (window, CELL); a closed window meets its neighbours afterwards
    g = s.groupBy(F.window(qcol(ts), width).alias("w"), "CELL").agg(*aggs)
    if neighbours is not None:
        mult = prep.neighbour_pairs(neighbours).groupBy("CELL", "N_CELL").agg(F.count(F.lit(1)).alias("_m"))
        g = g.join(prep.bounded_broadcast(mult), "CELL", "left").withColumn("_m", F.coalesce("_m", F.lit(1)))
    else:
        g = g.withColumn("N_CELL", F.lit(None).cast("string")).withColumn("_m", F.lit(1))
    idx = {src: i for i, src in enumerate(sources)}
    outs = []
    for sp in present:  # duplicate pairs multiply sums; means stay
        tot = F.col(f"_s{idx[sp.source]}") * F.col("_m")
        cnt = F.col(f"_c{idx[sp.source]}") * F.col("_m")
        val = tot.cast("double") if sp.agg == "sum" else tot.cast("double") / F.nullif(cnt, F.lit(0))
        outs.append(val.alias(sp.alias(suffix)))
    start, end = F.to_utc_timestamp(F.col("w.start"), tz), F.to_utc_timestamp(F.col("w.end"), tz)
    if ntz_output:
        start, end = start.cast("timestamp_ntz"), end.cast("timestamp_ntz")
    return g.select(start.alias("window_start"), end.alias("window_end"), "CELL", "N_CELL", *outs)


def state_session(spark: SparkSession, state_partitions: int) -> SparkSession:
    """A session for a stream with so many state-store partitions, apart from the caller's shuffles.  The number is
    recorded in the checkpoint and cannot change later; size it to the state volume."""
    side = spark.newSession()
    for k in ("spark.sql.session.timeZone", "spark.sql.adaptive.enabled"):
        side.conf.set(k, spark.conf.get(k))
    side.conf.set("spark.sql.shuffle.partitions", str(state_partitions))
    return side


def run_to_parquet(stream: DataFrame, sink: str, checkpoint: str, available_now: bool = True,
                   mode: str = "append"):
    """Start the stream into a Parquet sink and, with ``availableNow``, wait
    until everything present has been processed."""
    w = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint) \
        .outputMode(mode)
    q = w.trigger(availableNow=True).start() if available_now else w.start()
    if available_now:
        q.awaitTermination()
    return q


def scoring_sink(model: det.DriftModel, history_path: str, group: str | None = None
                 ) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that scores one micro-batch and writes
    its rows as the run ``stream-<batch id>`` of the history (``report.write_history``),
    which other jobs may share.  A replayed batch replaces its own rows, and no history
    is read per batch (its cost does not grow with the number of batches seen)."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        report.write_history(det.score(model, batch, group), history_path, f"stream-{int(batch_id)}")

    return handle


def run_scoring_stream(stream: DataFrame, model: det.DriftModel, history_path: str, checkpoint: str,
                       group: str | None = None):
    q = (stream.writeStream.foreachBatch(scoring_sink(model, history_path, group))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q
