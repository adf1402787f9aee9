"""Run ledger and gauges on Parquet tables.

The reference sends parameters, metrics and gauges to tracking and push
services.  Here the same facts are appended to tables under one base path,
so they can be queried with Spark like any other data:

``runs(run_id, parent_run_id, job, started_at, ended_at, duration_s, success, error)``
``params(run_id, key, value)``, ``metrics(run_id, key, value, logged_at)``,
``artifacts(run_id, name, path)`` and ``gauges(job, metric, value, ts)``.

The run row is written in ``finally``, so a failed job still leaves its
success flag, error text and duration (O1, O2).
"""

from __future__ import annotations

import datetime as dt
import os
import time
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

RUNS = "runs"
PARAMS = "params"
METRICS = "metrics"
ARTIFACTS = "artifacts"
GAUGES = "gauges"

SCHEMAS = {
    RUNS: "run_id string, parent_run_id string, job string, started_at timestamp, ended_at timestamp, "
          "duration_s double, success boolean, error string",
    PARAMS: "run_id string, key string, value string",
    METRICS: "run_id string, key string, value double, logged_at timestamp",
    ARTIFACTS: "run_id string, name string, path string",
    GAUGES: "job string, metric string, value double, ts timestamp",
}


class Run:
    def __init__(self, ledger: Ledger, job: str, parent_run_id: str | None):
        self.ledger = ledger
        self.job = job
        self.run_id = uuid.uuid4().hex
        self.parent_run_id = parent_run_id
        self.params: list[tuple] = []
        self.metrics: list[tuple] = []
        self.artifacts: list[tuple] = []
        self.gauges: list[tuple] = []

    def param(self, key: str, value) -> None:
        self.params.append((self.run_id, key, str(value)))

    def metric(self, key: str, value: float) -> None:
        self.metrics.append((self.run_id, key, float(value), dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)))

    def artifact(self, name: str, path: str) -> None:
        self.artifacts.append((self.run_id, name, path))

    def gauge(self, metric: str, value: float) -> None:
        """A named gauge value for this job (last value wins per read)."""
        self.gauges.append((self.job, metric, float(value), dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)))


class Ledger:
    def __init__(self, spark: SparkSession, base_path: str):
        self.spark = spark
        self.base = base_path

    def path(self, table: str) -> str:
        return os.path.join(self.base, table)

    def _append(self, table: str, rows: list[tuple]) -> None:
        if rows:
            self.spark.createDataFrame(rows, SCHEMAS[table]).coalesce(1).write.mode("append").parquet(self.path(table))

    @contextmanager
    def run(self, job: str, parent_run_id: str | None = None):
        """S13 + O1 + O2 + O3: yields a ``Run``; on exit writes everything,
        the run row last, whatever happened inside."""
        r = Run(self, job, parent_run_id)
        started = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        t0 = time.perf_counter()
        error = None
        try:
            yield r
        except Exception as exc:  # recorded, then raised again
            error = f"{type(exc).__name__}: {exc}"
            raise
        finally:
            duration = time.perf_counter() - t0
            r.metric("job_duration_seconds", duration)
            r.gauge("job_duration_seconds", duration)
            r.gauge("job_success", 0.0 if error else 1.0)
            self._append(PARAMS, r.params)
            self._append(METRICS, r.metrics)
            self._append(ARTIFACTS, r.artifacts)
            self._append(GAUGES, r.gauges)
            ended = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
            self._append(RUNS, [(r.run_id, r.parent_run_id, job, started, ended, duration, error is None, error)])

    def read(self, table: str) -> DataFrame:
        """The table, or an empty frame of its schema when nothing was written."""
        try:
            return self.spark.read.schema(SCHEMAS[table]).parquet(self.path(table))
        except AnalysisException:
            return self.spark.createDataFrame([], SCHEMAS[table])

    def latest_gauges(self) -> DataFrame:
        """S12 read side: last value of every (job, metric)."""
        g = self.read(GAUGES)
        return g.groupBy("job", "metric").agg(F.max_by("value", "ts").alias("value"), F.max("ts").alias("ts"))

    def lineage(self) -> DataFrame:
        """O3: child runs with their parent's job name (self-join on the ids)."""
        runs = self.read(RUNS)
        parent = runs.select(F.col("run_id").alias("parent_run_id"), F.col("job").alias("parent_job"))
        return runs.join(parent, "parent_run_id", "left").select("run_id", "job", "parent_run_id", "parent_job",
                                                                   "success")
